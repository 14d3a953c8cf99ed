"""Quality rules on repetition inside a document, by suffix array and longest common prefixes.

Words are runs of characters other than ASCII white space. Suffixes of one document that start with a repeated
``min_words``-gram are sorted by prefix doubling (all documents of a slice at once, as ranks that never mix documents);
longest common prefixes of neighbours in that order give the LCP intervals. The deepest interval around a suffix is the
longest repeat that starts there, so that the union of the spans of all maximal repeats is the union of
``[start, start + longest)``. A document is rejected if these spans cover too much of it or if one repeat is too long.

A null or empty text has no words: all counts are 0, and it is rejected for its length. Repeated rows give repeated
results; an empty table gives an empty one; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, text_slices

RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])

BASE_WINDOW = 5


def group_starts(values: np.ndarray) -> np.ndarray:
    """Ranks: how many values are smaller."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rank


def shared(rank: np.ndarray) -> np.ndarray:
    """Positions whose rank others have too."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


class Repeats:
    """Suffixes of many documents; words holds one number a word, doc that word's document (rising)."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n = n = len(words)
        self.words, self.doc = words, doc
        self.end = np.searchsorted(doc, doc, "right")  # of the word's document
        self.levels: list[tuple[int, np.ndarray]] = []
        if n:
            self.levels.append((1, group_starts(doc * (int(words.max()) + 1) + words)))

    def _deeper(self, k: int, rank: np.ndarray, by: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of prefixes of k words and those of ``by`` after them; only places ``at`` share a rank so far."""
        rank, after = rank.copy(), at + k
        inside = after < self.end[at]
        follow = np.where(inside, by[np.minimum(after, self.n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[at]))
        at, follow = at[order], follow[order]
        group = rank[at]
        first = np.r_[True, group[1:] != group[:-1]]
        new = first | np.r_[True, follow[1:] != follow[:-1]]
        index = np.arange(len(at))
        within = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(first, index, 0))
        rank[at] = group + within
        return rank

    def window(self, k: int) -> np.ndarray:
        """Ranks of prefixes of k words."""
        have, rank = 1, self.levels[0][1]
        ranks = {1: rank}
        while have < k:
            step = max(x for x in ranks if x <= k - have)
            rank = self._deeper(have, rank, ranks[step], shared(rank))
            have += step
            ranks[have] = rank
        return rank

    def starts(self, k: int) -> np.ndarray:
        """Where windows of k words start that their document has twice or more."""
        if not self.n:
            return np.zeros(0, np.int64)
        at = shared(self.window(k))
        return at[at + k <= self.end[at]]

    def longest(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a repeat of k words or more starts, and the words of the longest that does."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank, have = self.window(k), k
        places = self.starts(k)
        levels = [(have, rank)]
        while len(at := shared(rank)):
            rank = self._deeper(have, rank, rank, at)
            have *= 2
            levels.append((have, rank))
        order = places[np.argsort(rank[places])]  # the suffix array of these places
        a, b = order[:-1], order[1:]
        lcp = np.zeros(len(a), np.int64)
        for step, ranks in [*reversed(levels), *[(1, self.levels[0][1])] * (k - 1)]:
            i, j = a + lcp, b + lcp
            same = (i < self.end[a]) & (j < self.end[b]) & (self.doc[a] == self.doc[b])
            same[same] = ranks[i[same]] == ranks[j[same]]
            same &= (i + step <= self.end[a]) & (j + step <= self.end[b])
            lcp += step * same
        lcp = np.where(lcp >= k, lcp, 0)
        return order, np.maximum(np.r_[0, lcp], np.r_[lcp, 0])


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def per_document(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array and whose they are."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def measure(text: pa.Array, min_words: int) -> dict[str, np.ndarray | list]:
    text = pc.fill_null(text, "")
    n = len(text)
    words, doc = flat(pc.ascii_split_whitespace(text))
    full = pc.not_equal(pc.binary_length(words), 0)
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    lines, owner = flat(pc.split_pattern(text, "\n"))
    full = pc.match_substring_regex(lines, "[^ \t-\r]")
    lines, owner = lines.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]
    keys = np.unique(owner * (len(lines.dictionary) + 1) + lines.indices.to_numpy())
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeats = Repeats(ids, doc)
    windows = repeats.starts(BASE_WINDOW)
    s, e = union(windows, windows + BASE_WINDOW)
    places, longest = repeats.longest(min_words)
    S, E = union(places, places + longest)  # a span never passes the end of its document, but two may touch there
    cut = np.flatnonzero(repeats.doc[S] != repeats.doc[E - 1]) if len(S) else []
    if len(cut):
        inner = [np.flatnonzero(np.diff(repeats.doc[S[c] : E[c]])) + 1 + S[c] for c in cut]
        S, E = np.sort(np.r_[S, *inner]), np.sort(np.r_[E, *inner])
    covered = np.zeros(repeats.n + 1, np.int64)
    np.add.at(covered, s, 1)
    np.add.at(covered, e, -1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[places], longest)
    spans: list[list] = [[] for _ in range(n)]
    first = np.searchsorted(doc, np.arange(n))
    for a, b in zip(S.tolist(), E.tolist()):
        k = doc[a]
        spans[k].append({"start": a - first[k], "end": b - first[k]})
    return {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": per_document(pc.utf8_length(words).to_numpy(), doc, n),
        "n_symbols": pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy().astype(np.int64),
        "n_dup_lines": np.bincount(owner, minlength=n).astype(np.int64) - np.bincount(keys // (len(lines.dictionary) + 1), minlength=n),
        "n_repeat_words": per_document(np.cumsum(covered[:-1]), doc, n),
        "covered_words": per_document(E - S, doc[S], n),
        "longest_repeat": most,
        "spans": spans,
    }


def repetition_rules(docs: DataFrame, min_words: int = 10, max_covered: float = 0.2, max_repeat: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict for every document.

    base_failed: under 10 words, or over 20 % of the words in 5-word windows that occur twice. kept: not so, and repeats
    of ``min_words`` words or more cover at most ``max_covered`` of the words, none of them over ``max_repeat`` words.
    """
    out = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            m = measure(batch.column("text"), min_words)
            m["base_failed"] = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            m["kept"] = ~m["base_failed"] & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(m[f.name], f.type) for f in list(out)[1:]], schema=out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)
