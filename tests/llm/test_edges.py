"""Hostile inputs, repeated keys and plain-loop versions of the corpus operators."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import bpe_tree, html_text, media, ngram_join, packing, quality, queries, repetition, tokenizing, toxicity
from tabulon.llm.common import stage, table

SF = "/root/testdata/sf0.001"
BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
LONG = 1_000_000


@pytest.mark.parametrize("run", [" " * LONG, "\n" * LONG, " \n" * (LONG // 2), "ab " + " " * 5000 + "c", "x" * LONG, " " * 4095 + "a"])
def test_long_runs(run):
    encoder = tokenizing.byte_bpe(BYTE)
    assert encoder.encode(run).tolist() == encoder.exact.encode(run, add_special_tokens=False).ids


def test_long_runs_packed(spark):
    rows = packing.pack_matched(spark.createDataFrame([(1, " " * LONG), (2, "a")], "doc_id long, text string"), BYTE).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(tokenizing.byte_bpe(BYTE).exact.encode(" " * LONG, add_special_tokens=False).ids) + 1


def test_best_fit_leaves_slack_in_one_bin():
    assert packing.best_fit_decreasing({240: 5, 155: 5}, 1024).bins == 2


def test_write_packed(spark, tmp_path):
    made = packing.pack_sequences(table(spark, SF, "documents"), BYTE)
    packing.write_packed(made, str(tmp_path / "packed"), 1024, 7)
    want = {r["sequence_id"]: r for r in made.collect()}
    rows = packing.read_packed(spark, str(tmp_path / "packed")).collect()
    ids, places, lengths = packing.matrices(rows)
    assert len(rows) == len(want) and ids.shape == places.shape == (len(rows), 1024)
    for i, r in enumerate(rows):
        w = want[r["sequence_id"]]
        n = w["n_tokens"]
        assert ids[i, :n].tolist() == w["ids"] and (ids[i, n:] == 7).all() and lengths[i].tolist() == w["cu_seqlens"]
        assert places[i].tolist() == w["position_ids"] + list(range(1024 - n))


def test_bpe_leaves(spark):
    rnd, library = random.Random(9), bpe_tree.word_bpe(WORD).library
    signs = [*"ab 1.,'\n\t éÉΣİ ́ s", "<|endoftext|>", "\x1c", "\x85", "　", "don't", "  ", "thein", "🙂", "٣", "\xa0"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    for leaf in (2, 5, 64):
        got = {r["doc_id"]: r for r in bpe_tree.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, leaf=leaf).collect()}
        for i, t in enumerate(texts):
            ids = library.encode(t, add_special_tokens=False).ids
            assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), (leaf, t)
            assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    with pytest.raises(ValueError):
        bpe_tree.word_bpe(BYTE)


def test_one_of_each_by_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black grey pink brown")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, c, 4), (7, b, 5), (5, b, 6), (None, a, 7), (None, a, 8), (11, "", 9), (11, None, 10)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _turn int"))
    assert kept.columns == ["doc_id", "text", "_turn"]
    assert sorted(r["_turn"] for r in kept.collect()) == [1, 3, 4, 7, 8, 9, 10]


def test_shared_half_digests(spark):
    rows = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 5, 2), (4, 6, 3), (5, None, None)], "doc_id long, node long, check long")
    got = {r["doc_id"]: r["node"] for r in ngram_join.told_apart(rows).collect()}
    assert got[1] == got[2] == 5 != got[3] and got[4] == 6 and got[5] is None


def test_large_blocks(spark, monkeypatch):
    """Members of a block that is dealt to several tasks still all meet."""
    monkeypatch.setattr(ngram_join, "PART", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rnd, passage, rows = random.Random(1), [f"p{i}" for i in range(40)], []
    for i in range(60):
        w = list(passage)
        for j in rnd.sample(range(40), rnd.choice([0, 1, 1, 2])):
            w[j] = f"z{rnd.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    own = {i: {tuple(t.split()[j : j + 5]) for j in range(36)} for i, t in rows}
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in own:
        for j in own:
            if 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    assert got == {i: find(i) for i in own}


def test_malformed_media(spark):
    sizes = media.full(b"stsz", struct.pack(">II", 1, 2**32 - 1))
    huge = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", sizes)))))
    assert media.read_iso(huge)[0].samples() == []
    nested = b""
    for _ in range(5000):
        nested = media.box(b"moov", nested)
    assert media.read_iso(nested) == []
    whole, rnd = media.iso_file(b"a" * 1920), random.Random(3)
    for _ in range(400):
        broken = bytearray(whole)
        for _ in range(rnd.randint(1, 6)):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        for track in media.read_iso(bytes(broken[: rnd.randint(0, len(broken))])):
            track.samples(), track.key_frames(), track.seconds
    columns = queries.op8_iso_media(spark, SF).columns
    assert {"codec", "seconds", "key_frames"} <= {*columns}


def test_html_scopes():
    def kept(page):
        return [b for b, role in html_text.blocks_of(page) if role != html_text.DROP]

    assert kept('<p>text<div class="ads"><p>Buy now</div><p>more') == ["text", "more"]
    assert kept("<ul><li>item<nav><li>menu<li>menu</nav>rest<li>next</ul>") == ["item", "rest", "next"]
    assert kept("<article><p>para<aside><p>Related</aside><p>more</article>") == ["para", "more"]
    assert kept('<body class="has-comments comments"><article class="comments-open"><p>x</article>') == ["x"]
    assert kept('<b><div class="ads">ad</b> more ad</div>text') == ["text"]
    assert kept("<table><tr><td>a<table><tr><td>b<td>c</table><td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert kept("<dl><dt>a<dd>b<dt>c</dl>") == ["a", "b", "c"]


def test_html_long_page():
    deep = "<div>" * 60_000 + "<b>" * 60_000 + "<p>x" + "</i></b>" * 60_000
    assert [b for b, _ in html_text.blocks_of(deep)] == ["x"]
    flat = "<li>a<div>" * 60_000
    assert len(html_text.blocks_of(flat)) == 60_000


# Plain loops.


def test_noisy_or_against_loop():
    rows = [("you idiot. fine day", 1), ("fine day. nice", 0), ("moron here", 1), ("good day", 0), ("nice good day", 0), ("an idiot and a moron", 1)] * 20
    model = toxicity.fit([(f"{t} {i}", y) for i, (t, y) in enumerate(rows)], least_g=3.0)
    for text in ["you idiot. fine day! moron", "", "nothing", "a. b. c"]:
        clean = 1.0
        for a, b in toxicity.sentences(text):
            z = model.bias
            for w in toxicity.WORD.findall(text[a:b].lower()):
                for f in [w] + [w[:n] + "-" for n in toxicity.BEGINNINGS if len(w) >= n]:
                    z += model.weights.get(f, 0.0)
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(model.score(text)[0] - (1 - clean)) < 1e-9


def test_noisy_or_gradient():
    """The slope that fitting uses, of the negative log likelihood in a sentence's log-odds, against finite differences."""
    def loss(z, y):
        total = np.logaddexp(0, z).sum()
        return total if y == 0 else -math.log(-math.expm1(-total))

    for z in (np.array([-1.0, 0.5, -3.0]), np.array([0.2])):
        total = np.logaddexp(0, z).sum()
        for y in (0, 1):
            pull = -1 / np.expm1(total) if y else 1.0
            for i in range(len(z)):
                d = np.eye(len(z))[i] * 1e-6
                assert abs((loss(z + d, y) - loss(z - d, y)) / 2e-6 - pull / (1 + math.exp(-z[i]))) < 1e-5


def test_quality_against_loop(spark):
    rnd = np.random.default_rng(2)
    x, y = rnd.normal(size=(300, 3)), (rnd.random(300) < 0.5) * 1.0
    x[:, 0] += y
    m = quality.Logistic(x, y)
    z = np.c_[(x - m.mean) / m.scale, np.ones(300)]
    p = np.array([1 / (1 + math.exp(-sum(a * b for a, b in zip(r, m.w)))) for r in z])
    slope = [sum((y[i] - p[i]) * z[i, j] for i in range(300)) - (m.w[j] if j < 3 else 1e-6 * m.w[j]) for j in range(4)]
    assert max(map(abs, slope)) < 1e-4
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    for r in quality.score_documents(docs, model).collect()[:50]:
        if model.mix is not None:
            o = [math.log(s / (1 - s)) for s in (min(max(r[c], 1e-12), 1 - 1e-12) for c in ("content_score", "metadata_score"))]
            z = sum(w * min(max((v - a) / s, -20), 20) for w, v, a, s in zip(model.mix.w, o, model.mix.mean, model.mix.scale)) + model.mix.w[-1]
            assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-4


def test_views_do_not_share(spark):
    """The metadata view does not move with the text, nor the content view with the record."""
    one = [(1, "plain words here", "en", "a", 16), (2, "## || 77 BUY!!\nx", "en", "a", 16), (3, "plain words here", "fr", "b", 9)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: [x.tolist() for x in quality.both_views([bytes(r["x"])])] for r in quality.featured(docs).collect()}
    assert rows[1][1] == rows[2][1] != rows[3][1] and rows[1][0] == rows[3][0] != rows[2][0]


def test_pipeline_on_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), f"none-{name.replace(' ', '-')}")
        assert docs.count() == 0


def test_op2_on_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(empty).collect()} == {(1, 1), (2, 2)}
    assert repetition.repetition_rules(empty).filter(F.col("n_words") > 0).count() == 0



def test_group_of_unlinked_near_copies_forms_few_pairs(spark, monkeypatch):
    """One large block whose members differ from one another by 0 to 8 words of a common base; most are not linked."""
    rnd, rows = random.Random(7), []
    for i in range(240):
        w = [f"b{j}" for j in range(120)]
        for _ in range(i % 5):
            w[rnd.randrange(120)] = f"u{rnd.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    sizes, real = [], ngram_join.linked
    monkeypatch.setattr(ngram_join, "linked", lambda pairs, *more: sizes.append(pairs.count()) or real(pairs, *more))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own, first = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows], list(range(240))
    links = [(i, j) for i in range(240) for j in range(i) if 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])]
    for _ in range(240):
        for i, j in links:
            first[i] = first[j] = min(first[i], first[j])
    assert got == dict(enumerate(first)) and 20 < len(set(first)) < 220
    assert sizes[-1] <= 2 * 240


def test_parities_differ_in_no_more_places_than_sets(spark):
    rnd, rows = np.random.default_rng(3), []
    for n, apart in [(1, 0), (10, 4), (16, 3), (17, 2), (32, 3), (100, 30), (130, 8), (4100, 900), (9000, 200)]:
        x = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.r_[x[: len(x) - apart // 2], rnd.integers(0, 1 << 63, apart - apart // 2, dtype=np.uint64)]
        rows.append((apart, ngram_join.parity(x).tolist(), ngram_join.parity(y).tolist()))
    found = spark.createDataFrame(rows, "apart int, x array<long>, y array<long>").select("apart", ngram_join.unlike(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(0.7 * r["apart"] <= r["n"] <= r["apart"] for r in found)
