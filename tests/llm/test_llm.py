"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import bpe_tree, html_text, licenses, media, ngram_join, packing, quality, queries, repetition, tokenizing, toxicity
from tabulon.llm.common import stage, table

SF = "/root/testdata/sf0.001"
BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns with clashing names.
ODD = [(1, None), (2, ""), (3, " \n "), (None, "a null id"), (5, "Same text here, twice."), (5, "Same text here, twice."), (7, "word " * 30_000), (8, "x" * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("length"), F.lit("z").alias("node"), F.lit("w").alias("score"))


def many(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# 1. Repetition.


def repeats(text, least):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]

    def covered(k):
        seen, out = {}, set()
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                out.update(j for i in at for j in range(i, i + k))
        return out

    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest = next((k for k in range(len(w), least - 1, -1) if covered(k)), 0)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered(5)), len(covered(least)), longest


@pytest.mark.parametrize("least", [3, 5, 10])
def test_repetition(least):
    rnd = random.Random(least)
    texts = [None, "", " \n ", "a", "a " * 40, "x y\nx y\n\nq\n x\x0bb"] + [" ".join(rnd.choice("ab" if i % 2 else "abcdé#") for _ in range(rnd.randint(0, 50))) for i in range(150)]
    m = repetition.measure(pa.array(texts), least)
    for i, t in enumerate(texts):
        assert tuple(int(m[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")) == repeats(t, least), repr(t)
        assert sum(s["end"] - s["start"] for s in m["spans"][i]) == m["covered_words"][i]


def test_repetition_rows(odd):
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(odd).collect()}
    assert not rows[7]["kept"] and rows[7]["longest_repeat"] == 29_999 and rows[1]["base_failed"] and rows[2]["n_words"] == 0
    assert repetition.repetition_rules(odd.limit(0)).count() == 0


# 2. N-gram Jaccard join.


def sets(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    own, parent = [(i, sets(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(own):
        for j, y in own[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in own}


def near_copies():
    rnd, rows = random.Random(4), []
    for _ in range(8):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 10)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 99)}"
            rows.append(" ".join(w + [f"y{rnd.randint(0, 50)}" for _ in range(rnd.choice([0, 0, 5]))]))
    passage = " ".join(f"b{i}" for i in range(30))
    rows += [f"{passage} " + " ".join(f"u{rnd.randint(0, 9999)}" for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    rows += ["", "  ", None, "Ab C", "aB c", "one", "one"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_ngram_join(spark):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(many(spark, rows).repartition(3)).collect()}
    assert got == components(rows)


def test_ngram_join_odd_rows(odd):
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 2), (3, 3), (None, None), (5, 5), (7, 7), (8, 8)}
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


# 3 and 7. Packing.


def first_fit_rows(lengths, capacity):
    """Best-fit decreasing, one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((r, i) for i, r in enumerate([*rooms, capacity]) if r >= n)[1]
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= n
    return len(rooms)


@pytest.mark.parametrize("planner", [packing.best_fit_decreasing, packing.large_item_matching])
def test_plans(planner):
    rnd = random.Random(7)
    for capacity in (10, 64, 100):
        for _ in range(40):
            lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
            counts = {n: lengths.count(n) for n in lengths}
            plan = planner(counts, capacity)
            bins = {}
            for length, rank, k, first, offset in plan.table().tolist():
                for b in range(first, first + k):
                    bins.setdefault(b, []).append((offset, length))
            placed = sorted(n for b in bins.values() for _, n in b)
            assert placed == sorted(lengths)
            for b in bins.values():
                at = 0
                for offset, n in sorted(b):
                    assert offset == at
                    at += n
                assert at <= capacity
                if planner is packing.large_item_matching:
                    assert sum(3 * n > capacity for _, n in b) <= 2
            if planner is packing.best_fit_decreasing:
                assert len(bins) == first_fit_rows(lengths, capacity)


def test_matched_packing(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        texts = docs.select("doc_id", "text").collect()
        encoder = tokenizing.byte_bpe(BYTE).exact
        want = sorted(((r["doc_id"] or -1), encoder.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in texts)
        rows = [r.asDict() for r in packing.pack_matched(docs, BYTE).collect()]
        ids = dict(want)
        for r in rows:
            own = ids[r["doc_id"] or -1][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r["ids_crc32"] and len(own) == r["length"]
        assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
        total = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == total.get(r["sequence_id"], 0)
            total[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(total.values()) <= 1024
    assert packing.pack_matched(odd.limit(0), BYTE).count() == 0


def test_packed_sequences(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        found = {}
        for r in packing.pack_sequences(docs, BYTE).collect():
            assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] == len(r["ids"]) <= 1024
            for key, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                assert r["position_ids"][a:b] == list(range(b - a))
                found.setdefault(key, []).append((start, r["ids"][a:b]))
        encoder = tokenizing.byte_bpe(BYTE).exact
        for r in docs.select("doc_id", "text").distinct().collect():
            want = encoder.encode(r["text"] or "", add_special_tokens=False).ids + [50256]
            got = [t for _, ids in sorted(found[r["doc_id"]]) for t in ids]
            assert got[: len(want)] == want or r["doc_id"] == 5
    padded = packing.pack_sequences(odd, BYTE, 64, 50256, 0).first()
    assert len(padded["ids"]) == 64


# 4. Toxicity.


def test_toxicity(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits / sum(r["toxic"] for r in rows) > 0.8 and hits / sum(r["predicted"] for r in rows) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    text = "A quiet line. You idiot and moron. Another line."
    score, bent = model.score(text)
    assert score > 0.5 and [text[s["start"] : s["end"]].strip() for s in bent] == ["You idiot and moron."]
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored) and scored[0]["predicted"] == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert empty.score("anything")[0] < 1e-6
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


# 5. Licenses.


def test_licenses(spark, odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(licenses.BASE_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_scan(table(spark, SF, "documents")).collect()}
    assert got == want
    grant = "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of the software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = {r["doc_id"]: r for r in licenses.license_scan(many(spark, [(1, "mit license MIT License cc by"), (2, grant), (3, "by cc license mit")])).collect()}
    assert rows[1]["n_base"] == 3 and rows[1]["labels"] == "cc-by,mit" and (rows[1]["first_word"], rows[1]["last_word"]) == (0, 4)
    assert rows[2]["n_base"] == 0 and rows[2]["labels"] == "mit" and 0.8 <= rows[2]["score"] < 1
    assert rows[3]["labels"] == "" and rows[3]["first_word"] is None
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(odd.limit(0)).count() == 0


# 6. BPE.


def test_tree_concatenation():
    bpe, rnd = bpe_tree.word_bpe(WORD), random.Random(5)
    for _ in range(120):
        alphabet = rnd.choice(["ab", "abcde", "thein", "aé", "o", "abcdefghijklmnopqrstuvwxyz"])
        for word in bpe.words("".join(rnd.choice(alphabet) for _ in range(rnd.randint(30, 300)))):
            whole = bpe.merge(bpe.symbols(word, True))
            assert [bpe.vocab[t] for t in whole] == [t.id for t in bpe.library.model.tokenize(word)]
            for most in (4, 16, 64):
                leaves = bpe_tree.halves(word, most)
                assert bpe.tree([bpe.merge(bpe.symbols(x, i == len(leaves) - 1)) for i, x in enumerate(leaves)]) == whole


def test_bpe(spark, odd):
    rnd = random.Random(6)
    signs = [*"ab 1.,'\n\t éÉΣİ ́ s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "　", "don't", "  ", "\r\n", "🙂", "٣", "\xa0"]
    texts = [t for _, t in ODD] + ["x" * 5000 + "<|endoftext|>" + "thein" * 1500 + "don't é " + "1" * 5000 + "!?" * 3000] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    library = bpe_tree.word_bpe(WORD).library
    got = {r["doc_id"]: r for r in bpe_tree.encode_decode(many(spark, list(enumerate(texts))), WORD).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(t)[:80]
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_tree.encode_decode(odd, WORD).count() == len(ODD) and bpe_tree.encode_decode(odd.limit(0), WORD).count() == 0


def test_byte_bpe():
    rnd, encoder = random.Random(8), tokenizing.byte_bpe(BYTE)
    signs = [*"ab 1.,'\n\t é  s", "<|endoftext|>", "\x1c", "\x85", "　", "don't", "  ", "\r\n", "🙂", "٣", "\xa0"]
    for _ in range(3000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert encoder.encode(t).tolist() == encoder.exact.encode(t, add_special_tokens=False).ids, repr(t)


# 8. Media.


def test_media(spark, odd):
    rows = media.media_columns(odd, with_media=True).collect()
    for r, (key, text) in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(ODD, key=lambda x: (x[0] or 0, len(x[1] or "")))):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(r["media"])) and r["seconds"] == len(payload) / 8000
        assert all((k["end"] - k["start"]) == 192 for k in r["key_frames"])
    assert media.media_columns(odd.limit(0)).count() == 0
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 5000, 0, 0)), media.box(b"minf", media.box(b"stbl", media.full(b"stsz", struct.pack(">IIIII", 0, 3, 10, 20, 30)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"stco", struct.pack(">III", 2, 100, 500)), media.full(b"stss", struct.pack(">II", 1, 2)))))))
    track = media.read_iso(moov)[0]
    assert track.samples() == [(100, 10), (110, 20), (500, 30)] and track.key_frames() == [(110, 20)] and track.seconds == 5
    assert media.read_iso(b"\x00\x00") == [] and media.read_iso(moov[:60]) == []
    files = spark.createDataFrame([("a", bytearray(moov)), ("b", None), ("c", bytearray(b"junk"))], "name string, data binary")
    assert [r["key"] for r in media.describe_media(files, "name", "data").collect()] == ["a"]


# 9. HTML.


def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(500):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got, rest = html_text.common_subsequence(a, b), iter(b)
        assert len(got) == best[-1][-1] and got == sorted(got) and all(a[i] in rest for i in got)


def test_html(spark):
    page = '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class="cookie-notice">We</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two  three<p>Four <b>bold</b>&nbsp;x</p><div class="comments"><p>nice</p></div><ul><li>a<li>b</ul></article><div id="sidebar">s</div><form>f</form><script>var t="</p>";</script><footer>&copy; q'
    rows = [(1, "http://a/x/1", "<p>menu</p><p>shared</p><p>own one</p>"), (2, "http://a/x/2", "<p>menu</p><p>shared</p><p>own two</p>"), (3, None, None), (None, "", ""), (5, "http://b/1", page), (6, "http://b/2", page), (7, "http://c/", "<p>alone")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    article = "Head & line\nOne two three\nFour bold x\na\nb"
    assert got == {1: "own one", 2: "own two", 3: "", None: "", 5: article, 6: article, 7: "alone"}
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differencing(spark):
    side = "<div>teasers everywhere</div><article>teaser of {0}</article><div>text {0}</div>"
    copy, menus = "<p>menu</p><p>the copied text</p>", "<p>menu</p>"
    rows = [(1, "http://a/x/1", side.format("one")), (2, "http://a/x/2", side.format("two"))]
    rows += [(10 + i, f"http://b/c/{i}", copy) for i in range(9)] + [(20, "http://b/d", menus), (21, "http://b/d/1", menus), (22, "http://b/d/2", "<p>menu</p><p>last</p>")]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
        assert got == {1: "teaser of one\ntext one", 2: "teaser of two\ntext two", **{10 + i: "the copied text" for i in range(9)}, 20: "", 21: "", 22: "last"}


def test_html_names():
    def kept(page):
        return [b for b, role in html_text.blocks_of(page) if role != html_text.DROP]

    assert kept('<div class="site has-sidebar"><article>a</article></div><div class="sidebar"><p>x</p><main>b</main><p>y</p></div>') == ["a", "b"]
    assert kept('<article><section id="related-work"><h2 id="market-share">h</h2>s</section><p class="search-history">p</p><p>of <math><mi>x</mi></math></article>') == ["h", "s", "p", "of x"]
    assert kept('<article>a<h3 class="related">h</h3><div class="post comments"><article>c</article></div><section id="search">s</section></article>') == ["a", "h", "s"]
    assert kept('<nav><article>x</article></nav><div id="sidebar">x</div><div role="navigation">x</div><div hidden>x</div><article class="comment">x</article><div data-id="menu">d</div>') == ["d"]


def test_html_runs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("pq"), f"/{rnd.randint(0, 3)}/{i}", [rnd.choice([1, 1, 1, 2, 3])]) for i in range(200)]
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {}
    for at, (row, host, path, content) in enumerate(order):
        sides = [next((r for r in side if r[1] == host and r[3] != content), None) for side in (order[:at][::-1], order[at + 1 :])]
        shared = [-1 if r is None else next((i for i, (x, y) in enumerate(zip(path, r[2])) if x != y), min(len(path), len(r[2]))) for r in sides]
        best = sides[1] if shared[1] > shared[0] else sides[0]
        want[row] = best and best[0]
    lines = spark.createDataFrame(rows, "row long, host string, path string, hashes array<long>").withColumn("roles", F.array(F.lit(0)))
    for partitions in ("4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["row"]: r["partner"] for r in html_text.nearest(lines).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == {k: v for k, v in want.items() if v is not None}


# 10. Quality.


def test_quality(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").filter(toxicity.held_out("doc_id")).collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.97
    assert quality.score_documents(odd, model).count() == len(ODD) and quality.score_documents(odd.limit(0), model).count() == 0
    assert quality.train(docs, labels.limit(0)).score(np.zeros((1, len(quality.CONTENT))), np.zeros((1, 1)))[0][0] == 0.5
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.score_documents(docs, model).filter("kept").collect()}


def test_quality_pool(spark):
    """All unlabelled rows take part, and sums over Spark tasks give the model of one batch in memory."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("plain words of text number "), "id")).otherwise(F.concat(F.lit("## $$ 7 || BUY!! "), "id")).alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).alias("quality"))
    model = quality.train(docs, labels)
    assert model.n_unlabelled == 8900

    rnd = np.random.default_rng(5)
    y = (rnd.random(4000) < 0.5) * 1.0
    width = len(quality.BASE_METADATA) + quality.SOURCES + quality.LANGS
    x = [(rnd.normal(size=(4000, n)) + y[:, None] * 0.8).astype("<f4") for n in (len(quality.CONTENT), width)]
    hashes = rnd.integers(0, quality.BUCKETS, 4000)
    rows = spark.createDataFrame([(r.tobytes(), int(h)) for r, h in zip(np.concatenate(x, 1)[200:], hashes[200:])], "x binary, hash long").repartition(5)
    known = [v[:200] for v in x]
    here = quality.co_train(known, y[:200], lambda f: f([v[200:] for v in x], hashes[200:]))
    there = quality.co_train(known, y[:200], quality.total_over(rows))
    assert all(np.allclose(a.w, b.w, atol=1e-4) for a, b in zip(here.views, there.views))
    models, most = quality.fit_views(known, y[:200], [], lambda f: None, 0.95), 100
    cuts = quality.surest(models, [], lambda f: f([v[200:] for v in x], hashes[200:]), most, 0.95)
    given = quality.taught([(models, cuts)], [v[200:] for v in x], hashes[200:], 0.95)
    for to in range(2):
        odds = models[1 - to].odds(x[1 - to][200:])
        for label, o in ((1, odds), (0, -odds)):
            took = given[to] == label
            assert 90 <= took.sum() <= most and o[took].min() >= np.sort(o)[-most] - 0.01


# The pipeline.


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF), name.replace(" ", "-"))
        if name == "toxicity":
            model = toxicity.train(before, table(spark, SF, "labels"))
            want = {r["doc_id"] for r in before.collect() if model.score(r["text"] or "")[0] < 0.5}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "near copies":
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in components([(r["doc_id"], r["text"]) for r in before.collect()]).values()}
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        else:
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}


def test_registered():
    assert sorted({int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()}) == list(range(1, 11))
