"""BPE encoding and decoding of whole texts, with tree concatenation for long text that has no place to split.

Every text is halved, wherever its middle falls, until no part is longer than ``leaf`` characters. The leaves are encoded
each by itself, then neighbours are joined: a window around the join is encoded again, and grows until what stands at
both its ends is what both sides had.

ASCII white space always separates pre-tokens of the vocabularies meant here (word ends, white space dropped; a file of
another kind is refused), so that a window grows by the stretches between white space, and agreement of the outermost
ones makes the join exact. Each distinct stretch is encoded once and a bounded cache serves the rest. A pre-token of more
than ``long_symbols`` symbols has no white space to lean on: Spark encodes the leaves of its halves as rows of their own,
and windows grow by tokens. A sequence of tokens is an encoding if and only if every two neighbours are the encoding of
their concatenation, so that agreement at both ends makes that join exact too.

Null texts count as empty (no tokens); repeated rows give repeated results; an empty table gives an empty one; other
columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, stage, text_slices
from tabulon.llm.tokenizing import byte_alphabet

#: Entries of each of a worker's two caches; a full one starts anew.
CACHE = 200_000
ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
#: Finished documents, or parts of a document with long pre-tokens: leaf is null for parts that are encoded already.
PARTS = T.StructType([
    *ENCODED.fields,
    T.StructField("row", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("leaf", T.StringType()),
    T.StructField("word", T.IntegerType()),
    T.StructField("ends_word", T.BooleanType()),
])


@dataclass
class Leaf:
    """A part of a text: its stretches between white space, what encodes them, and whether either end may cut one."""

    stretches: list[bytes]
    found: list[tuple[int, str, str]]
    starts_inside: bool
    ends_inside: bool


class WordBpe:
    """A tokenizer file with its library, and the same merges for parts of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pattern = None  # of pre-tokens in lower-cased text, where only these steps lead to them
        if {*steps} <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in steps and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and not splits[1]["use_regex"]:
            self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.shown_byte = {b: c for c, b in byte_alphabet().items()}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        for space in " \n\t\r\x0b\x0c":
            if self.stretch(f"ab{space}1{space}") != self.stretch("ab") + self.stretch("1"):
                raise ValueError(f"white space does not separate the tokens of {path}")
        self.cache: dict[bytes, tuple[int, str, str]] = {}
        self.word_cache: dict[str, tuple[int, str, str]] = {}

    def symbols(self, part: str, ends_word: bool) -> list[str]:
        return [*part[:-1], part[-1] + self.suffix] if ends_word else [*part]

    def merge(self, symbols: list[str]) -> list[str]:
        """The lowest-ranked pair first, the leftmost of equal ones, until none is left."""
        n, ranks = len(symbols), self.ranks
        after, before, token = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if token[i] != pair[0] or j >= n or token[j] != pair[1]:
                continue
            token[i], token[j], after[i] = pair[0] + pair[1], "", after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (token[i], token[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            if (k := before[i]) >= 0 and (p := (token[k], token[i])) in ranks:
                heapq.heappush(heap, (ranks[p], k, p))
        return [t for t in token if t]

    def pieces(self, token: str) -> list[str]:
        """The symbols that a token is made of."""
        if self.suffix and token.endswith(self.suffix):
            return self.symbols(token[: -len(self.suffix)], True)
        return [*token]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            middle = self.merge([s for t in [*a, *b] for s in self.pieces(t)])
            if (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            size *= 2

    def tree(self, parts: list[list[str]]) -> list[str]:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def stretch(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def shown(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.library.decode(ids, skip_special_tokens=False)

    def word(self, word: str) -> tuple[int, str, str]:
        """One pre-token, normalized."""
        if (hit := self.word_cache.get(word)) is None:
            if len(self.word_cache) >= CACHE:
                self.word_cache.clear()
            tokens = self.library.model.tokenize(word)
            hit = self.word_cache[word] = (len(tokens), " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens]))
        return hit

    def look_up(self, stretches: list[bytes]) -> list[tuple[int, str, str]]:
        """Number, ids and decoded text of each stretch; tokens are decoded as themselves, joined by spaces."""
        cache, found = self.cache, []
        for s in stretches:
            if (hit := cache.get(s)) is None:
                if len(cache) >= CACHE:
                    cache.clear()
                words = [self.shown([w]) if isinstance(w, int) else self.word(w) for w in self.words(s.decode())]
                words = [w for w in words if w[0]]
                hit = words[0] if len(words) == 1 else (sum(w[0] for w in words), " ".join([w[1] for w in words]), " ".join([w[2] for w in words]))
                cache[s] = hit
            found.append(hit)
        return found

    def leaf(self, text: str) -> Leaf:
        raw = text.encode()
        stretches = raw.split()
        return Leaf(stretches, self.look_up(stretches), not raw[:1].isspace(), not raw[-1:].isspace())

    def join_leaves(self, left: Leaf, right: Leaf) -> Leaf:
        """The leaf of both texts, from a window of stretches around the join."""
        if left.ends_inside and right.starts_inside:
            size = 1
            while True:
                a, b = left.stretches[-size:], right.stretches[:size]
                middle = [*a[:-1], a[-1] + b[0], *b[1:]]
                found = self.look_up(middle)
                if (len(a) == len(left.stretches) or found[0] == left.found[-size]) and (len(b) == len(right.stretches) or found[-1] == right.found[size - 1]):
                    break
                size *= 2
            left.stretches[-len(a) :], left.found[-len(a) :] = middle, found
            left.stretches += right.stretches[len(b) :]
            left.found += right.found[len(b) :]
        else:
            left.stretches += right.stretches
            left.found += right.found
        return Leaf(left.stretches, left.found, left.starts_inside, right.ends_inside)

    def tree_text(self, text: str, most: int) -> list[tuple[int, str, str]]:
        """Number, ids and decoded text of each stretch of a whole text."""
        if not text:
            return []
        leaves = [self.leaf(x) for x in halves(text, most)]
        while len(leaves) > 1:
            leaves = [self.join_leaves(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0].found

    def words(self, stretch: str) -> list[str | int]:
        """Pre-tokens of one stretch, special tokens as their ids."""
        if self.pattern is not None and stretch.isprintable() and max(stretch) < "\u0250" and "<|" not in stretch:  # normal forms already
            if stretch.isascii():
                return self.pattern.findall(stretch.lower())
            return ["".join([self.shown_byte[b] for b in w.encode()]) for w in self.pattern.findall(stretch.lower())]
        found: list[str | int] = []
        while stretch:
            at, token = min(((i, t) for t in self.special if (i := stretch.find(t)) >= 0), default=(len(stretch), ""), key=lambda x: (x[0], -len(x[1])))
            if text := stretch[:at]:
                normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
                found += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            if token:
                found.append(self.library.token_to_id(token))
            stretch = stretch[at + len(token) :]
        return found


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def halves(word: str, most: int) -> list[str]:
    """The leaves of halving a word until no part is longer."""
    parts = [word]
    while len(parts[-1]) > most:  # the last part is the longest
        parts = [x for p in parts for x in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, tokenizer: str, long_symbols: int = 2048, leaf: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts and digests of ids and of the decoded text, for every document."""
    out = arrow_schema(PARTS)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, row = word_bpe(tokenizer), TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            rows = []
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                stretches = (value or "").encode().split()
                row += 1
                if any(len(s) > long_symbols for s in stretches):
                    rows += [(key, None, None, None, row, k, *p) for k, p in enumerate(parts(bpe, stretches))]
                else:
                    found = [x for x in bpe.tree_text(value or "", leaf) if x[0]]
                    rows.append((key, sum(x[0] for x in found), digest(" ".join([x[1] for x in found])), digest(" ".join([x[2] for x in found])), *[None] * 6))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def parts(bpe: WordBpe, stretches: list[bytes]) -> Iterator[tuple]:
        done = array("I")
        for word_at, s in enumerate(stretches):
            if len(s) <= long_symbols:
                done.extend(bpe.stretch(s.decode()))
                continue
            for w, word in enumerate(bpe.words(s.decode())):
                if isinstance(word, int):
                    done.append(word)
                elif len(word) <= long_symbols:
                    done.extend(bpe.vocab[t] for t in bpe.merge(bpe.symbols(word, True)))
                else:
                    yield done.tobytes(), None, None, None
                    done = array("I")
                    leaves = halves(word, long_symbols // 2)
                    yield from ((None, leaf, (word_at << 12) + (w & 4095), k == len(leaves) - 1) for k, leaf in enumerate(leaves))
        yield done.tobytes(), None, None, None

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            ids = [x if leaf is None else array("I", [bpe.vocab[t] for t in bpe.merge(bpe.symbols(leaf, ends))]).tobytes() for x, leaf, ends in zip(*(batch.column(c).to_pylist() for c in ("ids", "leaf", "ends_word")))]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    def concatenate(rows: pd.DataFrame) -> pd.DataFrame:
        bpe, ids, leaves = word_bpe(tokenizer), [], []
        rows = rows.sort_values("part")
        for own, leaf, ends in zip(rows["ids"], rows["leaf"], rows["ends_word"]):
            own = array("I", own).tolist()
            if leaf is None:
                ids += own
                continue
            leaves.append([bpe.tokens[i] for i in own])
            if ends:
                ids += [bpe.vocab[t] for t in bpe.tree(leaves)]
                leaves = []
        n, shown, decoded = bpe.shown(ids)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].astype("Int64"), "n_tokens": [n], "ids_sha256": [digest(shown)], "decoded_sha256": [digest(decoded)]})

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = stage(own.mapInArrow(start, PARTS), "encoded")
    long = first.filter("row is not null").repartition("row", "part").mapInArrow(encode_leaves, PARTS)
    return first.filter("row is null").select(*ENCODED.names).unionByName(long.groupBy("row").applyInPandas(concatenate, ENCODED))
