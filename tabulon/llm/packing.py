"""Packing of tokenized documents into sequences of a fixed capacity.

Which piece goes where depends on lengths only, and there are at most ``capacity`` of them. So Spark counts the pieces
of each length, the driver plans over that histogram (``capacity`` numbers, whatever the corpus), and tasks look their
pieces' places up in the plan by (length, rank among the pieces of that length). No piece passes through the driver and
no group of pieces through one task.

Two planners: ``best_fit_decreasing`` (a segment tree over capacities finds the fullest bin that still takes a piece) and
``large_item_matching`` (pieces above a third of the capacity are paired greedily, at most two of them a bin; smaller
ones best-fit the gaps that remain).

Nulls and empty texts are documents of the end token alone; repeated rows are packed as often as they occur; an empty
table gives an empty result; columns besides doc_id and text are ignored. Ties between pieces of equal length are broken
by their place in the input; pieces of equal length are interchangeable.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, stage, text_slices
from tabulon.llm.tokenizing import byte_bpe

#: Rows of (part, length) counts that are broadcast at most (24 bytes each); more of them are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("rank", T.LongType()),
])
WITH_IDS = T.StructType([*PIECE.fields, T.StructField("ids", T.BinaryType())])


class CapacityTree:
    """Segment tree over room 0..capacity; finds the least room of at least n that some open bin has."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.width)

    def mark(self, room: int, used: bool) -> None:
        node = room + self.width
        self.used[node] = used
        while node > 1:
            node >>= 1
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def least(self, room: int) -> int | None:
        node = room + self.width
        if room >= self.width:
            return None
        if self.used[node]:
            return room
        while node > 1:
            if not node & 1 and self.used[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node + (not self.used[2 * node])
                return node - self.width
            node >>= 1
        return None


class Plan:
    """Rows (length, first rank, pieces, first bin, offset): the pieces of a length with these ranks go to as many bins in turn."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, dict(counts)
        self.next_rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of bins (first, number)
        self.tree = CapacityTree(capacity)

    def put(self, length: int, room: int, most: int | None = None) -> int:
        """Put one piece into each of some bins that have this room; returns into how many."""
        first, number = self.open[room].pop()
        k = min(number, self.left[length], number if most is None else most)
        if k < number:
            self.open[room].append((first + k, number - k))
        if not self.open[room]:
            self.tree.mark(room, False)
        self._place(length, k, first, self.capacity - room)
        return k

    def start(self, length: int, number: int) -> None:
        """Put one piece into each of ``number`` new bins."""
        self._place(length, number, self.bins, 0)
        self.bins += number

    def _place(self, length: int, k: int, first: int, offset: int) -> None:
        self.rows.append((length, self.next_rank[length], k, first, offset))
        self.next_rank[length] += k
        self.left[length] -= k
        room = self.capacity - offset - length
        self.open[room].append((first, k))
        if room:
            self.tree.mark(room, True)

    def best_fit(self, lengths: list[int]) -> None:
        """Best-fit decreasing: each piece to the fullest bin that takes it, else to a new one."""
        for length in sorted(lengths, reverse=True):
            while self.left[length]:
                room = self.tree.least(length)
                if room is not None:
                    self.put(length, room)
                else:
                    self.start(length, max(1, self.left[length] // (self.capacity // length)))  # full bins, then one for the rest

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity, counts)
    plan.best_fit([n for n in counts if counts[n]])
    return plan


def large_item_matching(counts: dict[int, int], capacity: int) -> Plan:
    """Pieces above a third of the capacity: the longest that is left opens a bin and takes the longest partner that still
    fits, so that a bin holds two of them at most. Then the others, longest first, best-fit what room there is."""
    plan = Plan(capacity, counts)
    large = sorted((n for n in counts if counts[n] and 3 * n > capacity), reverse=True)
    for length in large:
        while plan.left[length]:
            partner = next((n for n in large if n <= length and n <= capacity - length and plan.left[n]), None)
            if partner is None:
                plan.start(length, plan.left[length])
            elif partner == length:
                if plan.left[length] > 1:
                    half = plan.left[length] // 2
                    plan.start(length, half)
                    plan.put(length, capacity - length, half)
                else:
                    other = next((n for n in large if n < length and n <= capacity - length and plan.left[n]), None)
                    plan.start(length, 1)
                    if other is not None:
                        plan.put(other, capacity - length, 1)
            else:
                k = min(plan.left[length], plan.left[partner])
                plan.start(length, k)
                plan.put(partner, capacity - length, k)
    plan.best_fit([n for n in counts if counts[n] and 3 * n <= capacity])
    return plan


def cut(n: int, capacity: int, short_first: bool) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; one of them may be shorter, the first or the last."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity if short_first else 0
    starts = [0] * bool(head) + list(range(head, n, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n])]))


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, short_first: bool, with_ids: bool, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Pieces of all documents with their part (the task that made them) and rank among its pieces of that length."""
    schema = WITH_IDS if with_ids else PIECE
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = byte_bpe(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        kind = np.uint16 if encoder.exact.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in text_slices(batches):
            rows = []
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(value or "")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                for piece, (start, length) in enumerate(cut(len(ids), capacity, short_first)):
                    own = ids[start : start + length]
                    row = (key, piece, start, length, None if with_ids else zlib.crc32(own.astype("<u4").tobytes()), part, seen[length])
                    rows.append((*row, own.astype(kind).tobytes()) if with_ids else row)
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    return own.mapInArrow(run, schema)


def placed(pieces: DataFrame, capacity: int, planner) -> DataFrame:
    """Adds sequence_id and offset to staged pieces. Pieces of no token (only without an end token) get a null place."""
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    totals = per_part.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # at most `capacity` rows
    if sum(r["rows"] for r in totals) <= BROADCAST_ROWS:
        before = F.broadcast(before)
    plan = planner({r["length"]: r["n"] for r in totals if r["length"]}, capacity).table()
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("rank", F.col("rank") + F.col("_before")).drop("_part", "_length", "_before")
    schema = T.StructType([*(f for f in ranked.schema.fields if f.name not in ("part", "rank")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = arrow_schema(schema)
    keys = plan[:, 0] * (1 << 44) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)  # sorted: by length, then first rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            if not len(plan):
                at, hole = np.zeros(len(length), np.int64), np.ones(len(length), bool)
                rows = np.zeros((len(length), 5), np.int64)
            else:
                at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
                rows, hole = plan[np.maximum(at, 0)], length == 0
            place = {"sequence_id": pa.array(rows[:, 3] + rank - rows[:, 1], pa.int64(), mask=hole), "offset": pa.array(rows[:, 4], pa.int64(), mask=hole)}
            yield pa.RecordBatch.from_arrays([place[f.name] if f.name in place else batch.column(f.name) for f in out], schema=out)

    return ranked.mapInArrow(run, schema)


def pack_matched(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2) -> DataFrame:
    """Best-fit packing with large-item matching: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than the capacity are cut into full pieces, of which the first may be shorter.
    """
    pieces = stage(tokenized_pieces(docs, tokenizer, capacity, end_id, True, False), "pieces")
    return placed(pieces, capacity, large_item_matching)


SEQUENCE = T.StructType([
    T.StructField("sequence_id", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("position_ids", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
])


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 50256, pad_id: int | None = None) -> DataFrame:
    """Best-fit-decreasing packing into rows of token ids, one row a sequence.

    ids: the row of the packed matrix (padded with ``pad_id`` to the capacity where that is given); cu_seqlens:
    cumulative lengths of its segments, from 0; position_ids: positions, which start again at 0 with each segment;
    doc_ids and starts: whose tokens each segment holds and from where in the document. Overlong documents are cut into
    pieces of the capacity, the last one shorter; nothing is lost.
    """
    pieces = stage(tokenized_pieces(docs, tokenizer, capacity, end_id, False, True), "pieces")
    rows = placed(pieces, capacity, best_fit_decreasing).filter("sequence_id is not null").drop("ids_crc32", "piece")
    out = arrow_schema(SEQUENCE)
    from tokenizers import Tokenizer

    kind = np.uint16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32

    def one(sequence: int, segments: list[tuple[int, int, bytes]]) -> tuple:
        ids = [np.frombuffer(x, kind).astype(np.int32) for _, _, x in segments]
        lengths = [len(x) for x in ids]
        total = sum(lengths)
        if pad_id is not None and total < capacity:
            ids.append(np.full(capacity - total, pad_id, np.int32))
        return (sequence, total, np.concatenate(ids), np.cumsum([0, *lengths], dtype=np.int32), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]), [x[0] for x in segments], [x[1] for x in segments])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        at, segments, made = None, [], []
        for batch in batches:
            for sequence, key, start, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "doc_id", "start", "ids"))):
                if sequence != at:
                    if segments:
                        made.append(one(at, segments))
                    at, segments = sequence, []
                segments.append((key, start, ids))
                if len(made) >= 512:
                    yield table(made)
                    made = []
        if segments:
            made.append(one(at, segments))
        if made:
            yield table(made)

    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, SEQUENCE)


PACKED = T.StructType([
    T.StructField("sequence_id", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.BinaryType()),
    T.StructField("position_ids", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
])


def write_packed(sequences: DataFrame, path: str, capacity: int = 1024, pad_id: int = 0) -> None:
    """Write packed sequences as rows of binary matrices, in Parquet.

    ids: ``capacity`` little-endian unsigned 32-bit ids, ``pad_id`` behind the last token; position_ids: as many positions,
    which start again at 0 with each segment and go on from 0 in the padding; cu_seqlens: the segments' cumulative
    lengths, from 0. ``read_packed`` gives the table back; ``matrices`` gives a batch of its rows as numpy arrays.
    """
    out = arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            inside = np.arange(capacity) < n[:, None]
            ids, places = np.full(inside.shape, pad_id, "<u4"), np.maximum(np.arange(capacity) - n[:, None], 0).astype("<u4")
            ids[inside] = plain(batch.column("ids"), inside.sum())
            places[inside] = plain(batch.column("position_ids"), inside.sum())
            lengths = [np.asarray(x, "<u4").tobytes() for x in batch.column("cu_seqlens").to_pylist()]
            columns = {"ids": pa.array([r.tobytes() for r in ids], pa.binary()), "position_ids": pa.array([r.tobytes() for r in places], pa.binary()), "cu_seqlens": pa.array(lengths, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(f.name)) for f in out], schema=out)

    def plain(lists: pa.Array, total: int) -> np.ndarray:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        assert len(values) == total, "write sequences without padding"
        return values

    sequences.mapInArrow(run, PACKED).write.option("compression", "zstd").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(path)


def matrices(rows: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The id matrix, the position matrix and the cumulative segment lengths of some rows of a packed table."""
    ids, places = (np.stack([np.frombuffer(r[c], "<u4") for r in rows]) if rows else np.zeros((0, 0), "<u4") for c in ("ids", "position_ids"))
    return ids, places, [np.frombuffer(r["cu_seqlens"], "<u4") for r in rows]
