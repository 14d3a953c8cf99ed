"""Quality classification by co-training of two views.

The content view sees the text: how many words end in symbols or shout, repeat the word before them, are bars or digits,
how varied they are, the shares of letters, capitals and signs, and how it is laid out in lines. The metadata view never
sees the text: it has the record's declared length, language and source. Each view is a logistic classifier fitted on
labelled rows. Over some rounds each labels the unlabelled rows that it is most sure of, for the other view to learn from.
Labelled rows that neither was fitted on are dealt in two: one part calibrates both views, the other fits the logistic
combination of the calibrated log-odds that scores all documents.

Fitting uses at most ``max_labelled`` labelled rows, those with the smallest hash of doc_id (a documented bound). All
unlabelled rows take part: their features are written once, each pass over them adds up a view's gradient and Hessian or
counts its sure rows, and tasks send those sums alone. Which rows are taught follows from the models and cuts of the
rounds before and is not stored. Every document is scored from its whole text.

A null or empty text has no words and is scored by what its views say of that; null metadata counts as its own value;
repeated rows get equal scores; without labelled rows of both classes every score is the base rate (0.5 without labels).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, stage, text_slices
from tabulon.llm.repetition import flat
from tabulon.llm.toxicity import held_out

CONTENT = ["ends_in_signs", "shouts", "repeats", "bars", "digits", "variety", "word_length", "plain", "capitalized", "signs_inside", "log_words", "lines", "line_length", "longest_line", "blank_lines", "letters", "capitals", "signs", "spaces", "log_bytes_a_char"]
BASE_METADATA = ["has_chars", "log_chars", "log_chars_squared"]
#: Powers of two by which declared lengths are told apart.
LENGTHS = 24
#: Hash buckets of the metadata's two names.
SOURCES, LANGS = 32, 16
#: Buckets of log-odds, and of hashes among equal log-odds, by which a round's surest rows are cut off.
BUCKETS = 4096

FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("x", T.BinaryType()),
])
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("content_score", T.DoubleType()),
    T.StructField("metadata_score", T.DoubleType()),
])


def content_view(text: pa.Array) -> np.ndarray:
    n = len(text)
    words, doc = flat(pc.ascii_split_whitespace(text))
    full = pc.not_equal(pc.binary_length(words), 0)
    words, doc = words.filter(full).dictionary_encode(), doc[full.to_numpy(zero_copy_only=False)]
    kinds, at = words.dictionary, words.indices.to_numpy()
    has = lambda pattern: pc.match_substring_regex(kinds, pattern).to_numpy(zero_copy_only=False).astype(np.float32)
    shapes = [has(r"[^\pL\pN\s.,;:!?]{2,}$|[#*$%&|<>]$"), has(r"^[^\pL]*(\p{Lu}{2,})[^\pL]*$|!!$"), has(r"^[^\pL\pN]+$"), has(r"\pN"), pc.utf8_length(kinds).to_numpy().astype(np.float32), has(r"^\pL?\p{Ll}*[.,;:!?]?$"), has(r"^\p{Lu}\p{Ll}*"), has(r"\pL[^\pL'’-]+\pL")]
    count = np.bincount(doc, minlength=n)
    least = np.maximum(count, 1)
    rate = [np.bincount(doc, x[at], n) / least for x in shapes] if len(kinds) else [np.zeros(n)] * len(shapes)
    same = np.r_[False, (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])] if len(at) else np.zeros(0, bool)
    distinct = np.bincount(np.unique(doc * (len(kinds) + 1) + at) // (len(kinds) + 1), minlength=n)
    variety = np.log1p(distinct) / np.log1p(least)
    words_say = np.stack([rate[0], rate[1], np.bincount(doc, same, n) / least, rate[2], rate[3], variety, rate[4] / 10, rate[5], rate[6], rate[7], np.log1p(count) / 10], 1)
    return np.concatenate([words_say, layout(text)], 1).astype(np.float32)


def layout(text: pa.Array) -> np.ndarray:
    n = len(text)
    lines, owner = flat(pc.split_pattern(text, "\n"))
    length = pc.utf8_length(lines).to_numpy()
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    size = np.maximum(pc.utf8_length(text).to_numpy(), 1)
    share = lambda pattern: pc.count_substring_regex(text, pattern).to_numpy() / size
    return np.stack([
        np.log1p(count) / 5, np.log1p(size / count) / 10, longest / size, np.bincount(owner, length == 0, n) / count,
        share(r"[a-zA-Z]"), share(r"[A-Z]"), share(r"[#*$%&|<>!@=+]"), share(r"[ \n\t]"), pc.binary_length(text).to_numpy() / size - 1,
    ], 1)


def metadata_view(chars: pa.Array, lang: list, source: list) -> np.ndarray:
    import zlib

    n, rows = len(chars), np.arange(len(chars))
    length = np.log1p(np.maximum(pc.fill_null(chars, 0).to_numpy(), 0))
    base = np.stack([pc.is_valid(chars).to_numpy(zero_copy_only=False), length / 10, length**2 / 100], 1)
    names = np.zeros((n, SOURCES + LANGS + LENGTHS))
    names[rows, SOURCES + LANGS + np.minimum(length / np.log(2), LENGTHS - 1).astype(int)] = 1
    names[rows, [zlib.crc32((x or "").encode()) % SOURCES for x in source]] = 1
    names[rows, [SOURCES + zlib.crc32((x or "").encode()) % LANGS for x in lang]] = 1
    return np.concatenate([base, names], 1).astype(np.float32)


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = pc.fill_null(batch.column("text"), "")
    return content_view(text), metadata_view(batch.column("n_chars"), batch.column("lang").to_pylist(), batch.column("source").to_pylist())


def inputs(docs: DataFrame) -> DataFrame:
    """The columns that views are made of; missing ones count as null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def featured(docs: DataFrame) -> DataFrame:
    out = arrow_schema(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = np.concatenate(views(batch), 1).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], schema=out)

    return inputs(docs).mapInArrow(run, FEATURES)


class Logistic:
    """Ridge logistic regression by Newton steps, on standardized features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        x = x.astype(float)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip(np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[:-1] + self.w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Two views' classifiers with their calibrations, and the combination of both."""

    def __init__(self, base: float = 0.5):
        self.base = base
        self.n_unlabelled = 0  # rows of the pool that the views taught each other on
        self.views: list[Logistic] = []
        self.calibrations: list[Logistic] = []
        self.mix: Logistic | None = None

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.mix is None:
            return (np.full(len(content), self.base),) * 3
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (content, metadata))]
        return sigmoid(self.mix.odds(np.stack(odds, 1))), sigmoid(odds[0]), sigmoid(odds[1])


Total = Callable[[Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]], list[np.ndarray] | None]


def both_views(rows: list[bytes]) -> list[np.ndarray]:
    x = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1) if rows else np.zeros((0, len(CONTENT) + len(BASE_METADATA) + SOURCES + LANGS + LENGTHS), "<f4")
    return [x[:, : len(CONTENT)], x[:, len(CONTENT) :]]


def total_over(rows: DataFrame) -> Total:
    """The sum of f(views, hashes) over the batches of all rows (x, hash); None without rows."""

    def total(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    got = f(both_views(batch.column("x").to_pylist()), batch.column("hash").to_numpy())
                    out = got if out is None else [a + b for a, b in zip(out, got)]
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["sums"])

        parts = [pickle.loads(r[0]) for r in rows.mapInArrow(run, "sums binary").collect()]  # a row a task, some 60 numbers square
        return [sum(x) for x in zip(*parts)] if parts else None

    return total


def bucket(odds: np.ndarray, sure: float) -> np.ndarray:
    """The bucket of log-odds, -1 if they are less than sure."""
    least = np.log(sure / (1 - sure))
    return np.where(odds >= least, np.minimum((odds - least) / (30 - least) * BUCKETS, BUCKETS - 1), -1).astype(int)


def sides(models: list[Logistic], x: list[np.ndarray]) -> Iterator[tuple[int, float, np.ndarray]]:
    """(view that is taught, label, log-odds of that label) of the four ways to teach."""
    for v in range(2):
        odds = models[v].odds(x[v])
        yield 1 - v, 1.0, odds
        yield 1 - v, 0.0, -odds


def taught(history: list, x: list[np.ndarray], hashes: np.ndarray, sure: float) -> list[np.ndarray]:
    """A view's pseudo-labels, given by the other in the rounds so far: rows above the cut bucket, and those in it whose
    hash is below the cut's."""
    labels = [np.full(len(hashes), np.nan) for _ in range(2)]
    for models, cuts in history:
        for (to, label, odds), (at, most) in zip(sides(models, x), cuts):
            b = bucket(odds, sure)
            labels[to][np.isnan(labels[to]) & ((b > at) | (b == at) & (hashes < most))] = label
    return labels


def surest(models: list[Logistic], history: list, total: Total, most: int, sure: float) -> list[tuple[int, int]]:
    """The cut (bucket, hash) of each way to teach, so that at most ``most`` new rows are above it."""

    def count(cuts: list[int] | None):
        def f(x, hashes):
            known, out = taught(history, x, hashes, sure), []
            for k, (to, _, odds) in enumerate(sides(models, x)):
                b = bucket(odds, sure)
                free = np.isnan(known[to]) & (b >= 0 if cuts is None else b == cuts[k])
                out.append(np.bincount((b if cuts is None else hashes)[free], minlength=BUCKETS))
            return out

        return f

    counts = total(count(None))
    above = [np.cumsum(c[::-1])[::-1] for c in counts]  # rows in a bucket or above it
    at = [int(np.flatnonzero(a > most)[-1]) if a[0] > most else -1 for a in above]
    inside = total(count(at)) if max(at) >= 0 else counts
    return [(0, BUCKETS) if b < 0 else (b, int(np.searchsorted(np.cumsum(i), most - (a[b] - c[b]), "right"))) for b, i, a, c in zip(at, inside, above, counts)]


def fit_views(labelled: list[np.ndarray], y: np.ndarray, history: list, total: Total, sure: float, ridge: float = 1.0, steps: int = 25) -> list[Logistic]:
    """Both views' ``Logistic`` by Newton steps on sums over labelled and taught rows, from zero: steps from the round before's
    weights can diverge."""

    def over(f: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        own = [a for v in range(2) for a in f(v, labelled[v].astype(float), y)]

        def pool(x, hashes):
            known = taught(history, x, hashes, sure)
            return [a for v in range(2) for a in f(v, x[v][~np.isnan(known[v])].astype(float), known[v][~np.isnan(known[v])])]

        more = total(pool) if history else None
        return own if more is None else [a + b for a, b in zip(own, more)]

    center = [x.astype(float).mean(0) for x in labelled]  # near the mean, so that squares lose no digits
    moments = over(lambda v, x, _: [np.array(float(len(x))), (x - center[v]).sum(0), ((x - center[v]) ** 2).sum(0)])
    models = []
    for v in range(2):
        n, first, second = moments[3 * v : 3 * v + 3]
        m = Logistic.__new__(Logistic)
        m.mean, m.scale = center[v] + first / n, np.maximum(np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)), 1e-3)
        m.w = np.zeros(len(m.mean) + 1)
        models.append(m)

    def newton(v: int, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        m = models[v]
        z = np.c_[(x - m.mean) / m.scale, np.ones(len(x))]
        p = 1 / (1 + np.exp(-np.clip(z @ m.w, -30, 30)))
        return [z.T @ (label - p), (z.T * (p * (1 - p) + 1e-6)) @ z]

    for _ in range(steps):
        sums, far = over(newton), 0.0
        for v, m in enumerate(models):
            penalty = np.r_[np.full(len(m.mean), ridge), 1e-6]
            step = np.linalg.solve(sums[2 * v + 1] + np.diag(penalty), sums[2 * v] - penalty * m.w)
            m.w, far = m.w + step, max(far, np.abs(step).max())
        if far < 1e-6:
            break
    return models


def co_train(labelled: list[np.ndarray], y: np.ndarray, total: Total, rounds: int = 5, share: float = 0.1, sure: float = 0.95) -> CoTrained:
    """Every fifth labelled row is for calibration; the rest starts both views, which then teach each other.

    A round hands over at most ``share`` of the unlabelled rows a class, the surest ones, and only those with a
    probability of ``sure`` or more."""
    if not len(y) or y.min() == y.max():
        return CoTrained(float(y.mean()) if len(y) else 0.5)
    for_calibration = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[for_calibration])) < 2:
        for_calibration = np.ones(len(y), bool)
    fitting = ~for_calibration if not for_calibration.all() else for_calibration
    if len(np.unique(y[fitting])) < 2:
        fitting = np.ones(len(y), bool)
    model = CoTrained()
    known, history = [x[fitting] for x in labelled], []
    size = total(lambda x, hashes: [np.array(len(hashes))])
    model.n_unlabelled = int(size[0]) if size else 0
    model.views = fit_views(known, y[fitting], history, total, sure)
    for _ in range(rounds if model.n_unlabelled else 0):
        history.append((model.views, surest(model.views, history, total, int(share * model.n_unlabelled), sure)))
        model.views = fit_views(known, y[fitting], history, total, sure)
    kept = np.flatnonzero(for_calibration)
    parts = [kept[::2], kept[1::2]]
    if any(len(np.unique(y[p])) < 2 for p in parts):  # too few rows of a class to deal in two
        parts = [kept, kept]
    first, second = ([v.odds(x[p])[:, None] for v, x in zip(model.views, labelled)] for p in parts)
    model.calibrations = [Logistic(z, y[parts[0]]) for z in first]
    model.mix = Logistic(np.concatenate([c.odds(z)[:, None] for c, z in zip(model.calibrations, second)], 1), y[parts[1]])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 8000) -> CoTrained:
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = marks.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    one = featured(docs.filter("doc_id is not null")).groupBy("doc_id").agg(F.min("x").alias("x"))  # repeated ids count once
    rows = stage(one.join(marks.select("doc_id", F.lit(True).alias("marked")), "doc_id", "left"), "features")
    own = rows.filter("marked").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "x").orderBy("doc_id").collect()  # at most max_labelled
    pool = rows.filter("marked is null").select("x", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("hash"))
    return co_train(both_views([bytes(r["x"]) for r in own]), np.array([r["label"] for r in own], float), total_over(pool))


def score_documents(docs: DataFrame, model: CoTrained, limit: float = 0.5) -> DataFrame:
    """doc_id, score, kept, content_score and metadata_score of every document."""
    out, shared = arrow_schema(SCORES), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            score, content, metadata = shared.value.score(*views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= limit), pa.array(content), pa.array(metadata)], schema=out)

    return inputs(docs).mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: CoTrained, limit: float = 0.5) -> DataFrame:
    """The rows that score the limit or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            own = pa.RecordBatch.from_arrays([batch.column(c).cast(k) if c in batch.schema.names else pa.nulls(batch.num_rows, k) for c, k in zip(names, kinds)], names=names)
            yield batch.filter(pa.array(shared.value.score(*views(own))[0] >= limit))

    return docs.mapInArrow(run, docs.schema)
