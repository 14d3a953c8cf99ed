"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import quality, toxicity
from tabulon.llm.bpe_tree import encode_decode
from tabulon.llm.common import shared_dir, table
from tabulon.llm.html_text import main_text
from tabulon.llm.licenses import license_scan
from tabulon.llm.media import media_columns
from tabulon.llm.ngram_join import jaccard_components
from tabulon.llm.packing import pack_matched, pack_sequences, read_packed, write_packed
from tabulon.llm.repetition import repetition_rules

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A public tokenizer's file; its place is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("spans")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as binary matrices to the shared folder and read back from there."""
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(pack_sequences(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")), path)
    return read_packed(spark, path)


def op4_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).withColumn("n_offending", F.size("offending")).drop("offending")


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_matched_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matched(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 2)


def op8_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_repetition_rules, op2_ngram_jaccard_join, op3_packed_sequences, op4_toxicity_noisy_or, op5_license_diagonals, op6_bpe_tree, op7_matched_packing, op8_iso_media, op9_page_differencing, op10_quality_cotraining)}


#: The whole join by all pairs that share a shingle.
JACCARD_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as shingle from d
), n as (select doc_id, count(*) as n from s group by doc_id
), met as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), links as (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
), both_ways as (select x, y from links union all select y, x from links
), reach(x, y) as (select doc_id, doc_id from documents union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least as component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as least from reach group by x) using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": JACCARD_SQL}
