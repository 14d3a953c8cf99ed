"""Toxicity by multiple-instance learning: documents are bags of sentences.

A document is toxic if any of its sentences is: its probability is the noisy-or of its sentences', 1 - prod(1 - p). Each
sentence's probability is a logistic function of the words in it and of the beginnings of those words. Only documents
carry labels; the gradient of the noisy-or finds the sentences that account for them, and the fitted model points out
offending sentences in any document.

The model is fitted on at most ``max_documents`` labelled rows (those with the smallest hash of doc_id) and on words and
beginnings that toxic ones of them have more often than chance explains, so that the model's size is bounded too; it scores every whole
text. Labels, lang, source and doc_id are not inputs of a score.

A null or empty text has one empty sentence and gets a low score; repeated rows get equal scores; null doc_ids count as
not held out; labels of unknown documents and null labels are ignored, and with several labels for a doc_id the highest
counts; without any labelled row or without both classes every score is the base rate (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, text_slices

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|\Z)")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
CACHE = 200_000

SCORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
])


def held_out(doc_id: Column | str) -> Column:
    """The rows whose labels are for evaluation only."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n or len(word) == n)]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()] or [(0, len(text))]


class NoisyOr:
    """Weights of features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        if (w := self.cache.get(word)) is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            w = self.cache[word] = math.fsum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def score(self, text: str, offending: float = 0.5) -> tuple[float, list[dict]]:
        lower, spans, bent, clean = text.lower(), sentences(text), [], 0.0
        same = len(lower) == len(text)
        for start, end in spans:
            z = self.bias + sum([self.word(w) for w in WORD.findall(lower[start:end] if same else text[start:end].lower())])
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= offending:
                bent.append({"start": start, "end": end, "score": p})
        return -math.expm1(clean), bent


def telling(rows: list[tuple[str, int]], least: float) -> list[str]:
    """Features that toxic documents have more often than chance explains: a likelihood ratio (G) of ``least`` or more."""
    totals, marked, plain = Counter(label for _, label in rows), Counter(), Counter()
    for text, label in rows:
        own = {*WORD.findall(text.lower())}
        (marked if label else plain).update(own.union(*({f"{w[:n]}-" for w in own if len(w) >= n} for n in BEGINNINGS)))
    share = totals[1] / len(rows)

    def g(a: int, b: int) -> float:
        n, toxic, clean = len(rows), totals[1], totals[0]
        cells = ((a, (a + b) * share), (b, (a + b) * (1 - share)), (toxic - a, (n - a - b) * share), (clean - b, (n - a - b) * (1 - share)))
        return 2 * sum(o * math.log(o / e) for o, e in cells if o)

    return sorted(f for f, a in marked.items() if a > (a + plain[f]) * share and g(a, plain[f]) >= least)


def fit(rows: list[tuple[str, int]], least_g: float = 20.0, steps: int = 300, rate: float = 0.1, sparsity: float = 5e-5) -> NoisyOr:
    """Full-batch Adam on the noisy-or likelihood over telling features, with soft thresholding; equal texts count once."""
    rows = sorted({text: label for text, label in sorted(rows)}.items())
    y = np.array([label for _, label in rows], float)
    if not len(rows) or y.min() == y.max():
        return NoisyOr({}, -50.0 if not len(rows) or not y.max() else 50.0)
    names = telling(rows, least_g)
    ids = {f: i for i, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    sent, feat, doc = [], [], []
    for d, (text, _) in enumerate(rows):
        for a, b in sentences(text):
            for w in WORD.findall(text[a:b].lower()):
                if (own := known.get(w)) is None:
                    own = known[w] = [ids[f] for f in features(w) if f in ids]
                if own:
                    feat += own
                    sent += [len(doc)] * len(own)
            doc.append(d)
    if not names:
        return NoisyOr({}, math.log(max(y.mean(), 1e-6) * len(rows) / len(doc)))
    sent, feat, doc = np.array(sent, np.int64), np.array(feat, np.int64), np.array(doc, np.int64)
    n, k = len(rows), len(names)
    w, b = np.zeros(k), math.log(max(y.mean(), 1e-3) * n / len(doc))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sent, w[feat], len(doc)) + b, -30, 30)
        total = np.bincount(doc, np.logaddexp(0, z), n)  # -log of the probability that no sentence is toxic
        pull = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        g = pull[doc] / (1 + np.exp(-z)) / n
        gw, gb = np.bincount(feat, g[sent], k), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w -= step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 10.0) * sparsity, 0)
        b -= rate * mb / (1 - 0.9**t) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return NoisyOr({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that are not held out, by the hash of their ids."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = marks.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    first = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("r"))
    return first.select("doc_id", "r.text", "r.label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_documents: int = 8000, max_chars: int = 40_000_000) -> NoisyOr:
    """``max_chars`` bounds the text brought to the driver: documents share it in the order of their ids' hashes, whole ones
    only, so that short and long ones are as frequent as among all."""
    rows = training_rows(docs, labels, label, max_documents)
    sizes = rows.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # bounded by max_documents
    room, fits = max_chars, []
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            fits.append((r["doc_id"],))
    if len(fits) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long")), "doc_id")
    return fit(sorted((r["text"], r["label"]) for r in rows.select("text", "label").collect()))


def score_documents(docs: DataFrame, model: NoisyOr, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (character spans) of every document."""
    out = arrow_schema(SCORED)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    made: list[NoisyOr] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(NoisyOr(*shared.value))
        for batch in text_slices(batches):
            rows = []
            for key, out_, value in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                score, bent = made[0].score(value or "")
                rows.append((key, out_, score, int(score >= 0.5), bent))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: NoisyOr, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose text scores under the limit, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    made: list[NoisyOr] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(NoisyOr(*shared.value))
        for batch in text_slices(batches, text):
            good = [made[0].score(t or "")[0] < limit for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
