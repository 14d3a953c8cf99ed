"""N-gram Jaccard join: documents whose sets of word shingles overlap, and their connected components.

The join is a sparse product of the document-by-shingle incidence with itself, in blocks of equal shingles, of which only
the part is formed that can hold a pair: shingles are put in one global order, rare ones first (by a sketch of counts of
fixed size), and two sets of Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles. Pairs whose sizes
or places rule them out are never formed. For the others the product is summed: the incidence of all shingles of both
nodes is cut into two blocks of shingles, each adds its count of common ones to the pair, pairs that the first block rules
out leave early, and the sum decides.

Equal sets form one class first, so that copies cost nothing. A block of similar documents does not need all its pairs:
only components are asked for. First every member is compared with one hub of the block; components follow; then, in
further rounds, with another hub where a block still spans several components; and last all pairs that still join
different components. Pairs inside a component are never formed, nor those across components whose sketches of parities
differ too much: bits of two sets differ in no more places than the sets, so that members of a group of near copies that
are not linked are told apart before their pair is formed, and no link between different components is missed.

A null, empty or blank text has no shingle and is linked with nothing, not even its like; a null doc_id is linked with
nothing and has a null component; repeated rows are copies; an empty table gives an empty result; other columns are
dropped. Two sets count as equal if 128-bit digests of their sorted shingles are.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_schema, discard, stage, text_slices
from tabulon.llm.repetition import flat

#: Counters of the sketch: 8 MB, whatever the corpus; it only orders shingles, so its errors cost time, not pairs.
SKETCH_BITS = 21
SKETCH_BLOCKS = 32
#: Rows of two numbers that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Shingles in open blocks that a node's rows carry as a list at most.
LISTED = 1024
#: The first block of the product holds the shingles whose first bits are 0: a quarter of them. All others are the second.
BLOCK_BITS = 2
#: Bits of parity a shingle, and of a set at least and at most (powers of two); of larger sets they rule out less.
PARITY_BITS, LEAST_BITS, MOST_BITS = 2, 64, 16384
#: Members of a block that meet its others in one task.
PART = 2000
#: Members of a block whose pairs are formed without lists at most.
SMALL_BLOCK = 8

PROFILE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_hash", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("node", T.LongType()),
    T.StructField("check", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())),
    T.StructField("parity", T.ArrayType(T.LongType())),
])
PIECE = T.StructType([
    T.StructField("node", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("own", T.ArrayType(T.LongType())),
])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text and whose they are; a text of fewer words is one shingle."""
    words, doc = flat(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, ""))))
    full = pc.not_equal(pc.binary_length(words), 0)
    words, doc = words.filter(full).dictionary_encode(), doc[full.to_numpy(zero_copy_only=False)]
    if not len(doc):
        return np.zeros(0, np.uint64), doc
    kinds = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    own = kinds[words.indices.to_numpy()]
    count = np.bincount(doc, minlength=len(text))
    left = np.repeat(np.cumsum(count), count) - np.arange(len(doc))  # words from here to the end of the text
    size = np.minimum(count[doc], k)
    total = np.zeros(len(doc), np.uint64)
    for j in range(k):
        more = own[j:] if j else own
        total[: len(more)] = np.where((size > j)[: len(more)], total[: len(more)] * np.uint64(0x9E3779B97F4A7C15) + more, total[: len(more)])
    whole = left >= size
    whole &= (count[doc] >= k) | (left == count[doc])
    return mixed(total[whole] + size[whole].astype(np.uint64)), doc[whole]


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits by the low bits of hashes: whether an odd number of them fell there. Of a set, as 64-bit words."""
    bits = min(max(LEAST_BITS, 1 << (PARITY_BITS * len(hashes) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def unlike(x: Column, y: Column) -> Column:
    """Places where two parities differ: at most the number of shingles that one of the sets has alone. The longer one is
    folded; of sets whose sizes fit, it has twice the words at most."""
    words = F.least(F.size(x), F.size(y))
    fold = lambda p: F.when(F.size(p) == words, p).when(F.size(p) == 2 * words, F.zip_with(F.slice(p, 1, words), F.slice(p, words + 1, words), lambda a, b: a.bitwiseXOR(b)))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by the low bits of their hashes. Tasks add up their own; blocks of counters are summed apart."""
    width, block = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    out = arrow_schema(schema)

    def table(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in text_slices(batches):
            at, n = np.unique((shingles(batch.column("text"), k)[0] & np.uint64(width - 1)).astype(np.int64), return_counts=True)
            total[at] += n.astype(np.uint32)
        if total.any():
            yield table({b: total[b * block : (b + 1) * block] for b in range(SKETCH_BLOCKS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(x, np.uint32)
                sums[b] = sums[b] + np.minimum(own, ~sums[b]) if b in sums else own
        if sums:
            yield table(sums)

    found = np.zeros(width, np.uint32)
    for r in docs.select("text").mapInArrow(count, schema).repartition(SKETCH_BLOCKS, "block").mapInArrow(add, schema).collect():
        found[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.uint32)
    return found


def profile(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Size, class, prefix and parity of every document's set; a task gives the last two of a class once."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, k))
    out = arrow_schema(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in text_slices(batches):
            hashes, doc = shingles(batch.column("text"), k)
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
            hashes, doc = hashes[new], doc[new]
            size = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(size) - size
            rank = counts.value[(hashes & np.uint64(len(counts.value) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)
            ordered = hashes[np.lexsort((rank, doc))]  # a stable sort: equal ranks stay in the order of their hashes
            nodes, checks, prefixes, parities = [], [], [], []
            for i, n in zip(first.tolist(), size.tolist()):
                node, check = struct.unpack("<qq", hashlib.blake2b(hashes[i : i + n].tobytes(), digest_size=16).digest()) if n else (None, None)
                fresh = n and (node, check) not in seen
                seen.add((node, check))
                nodes.append(node)
                checks.append(check)
                prefixes.append(ordered[i : i + n - -(-percent * n // 100) + 1].view(np.int64) if fresh else None)
                parities.append(parity(hashes[i : i + n]) if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int32()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))], schema=out)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, PROFILE)


def pieces(texts: DataFrame, k: int, first: bool) -> DataFrame:
    """Rows of the incidence matrix: (node, n, block, own), own the node's shingles in that block, n all of them. The first
    block (0) has a row for every node, all others together (1) where it has shingles."""
    out = arrow_schema(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for batch in text_slices(iter([wide])):
                hashes, doc = shingles(batch.column("text"), k)
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
                hashes, doc = hashes[new], doc[new]
                n = np.bincount(doc, minlength=batch.num_rows)
                key = doc << BLOCK_BITS | np.minimum(hashes >> np.uint64(64 - BLOCK_BITS), 1).astype(np.int64)
                mine = (key & (1 << BLOCK_BITS) - 1 == 0) == first
                keys = np.arange(batch.num_rows) << BLOCK_BITS if first else np.unique(key[mine])
                ends = np.searchsorted(key[mine], keys, "right")
                own = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(hashes[mine].view(np.int64)))
                at = keys >> BLOCK_BITS
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(n[at], pa.int32()), pa.array(keys & (1 << BLOCK_BITS) - 1, pa.int32()), own], schema=out)

    return texts.select("node", "text").mapInArrow(run, PIECE)


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that overlap enough. Each block of the product adds its count of common shingles to a pair.
    The first block goes alone: where its count and all that the smaller rest could add stay below the bound that the
    sizes set, the pair is discarded before the other blocks are formed; at the end the sum decides. Only nodes of these
    pairs get rows of the incidence; where the pairs are few they go to the rows of a, which stay in place."""
    met = F.size(F.array_intersect("own_a", "own_b"))
    reaches = lambda overlap: (100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))

    def product(pairs: DataFrame, first: bool) -> DataFrame:
        small = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df

        def side(name: str) -> DataFrame:
            nodes = pairs.select(F.col(name).alias("node")).distinct()
            found = pieces(texts.join(small(nodes), "node", "left_semi"), k, first)
            return found.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), "block", F.col("own").alias(f"own_{name}"))

        return side("a").join(small(pairs), "a").join(side("b"), ["b", "block"])

    rest = F.least(F.col("n_a") - F.size("own_a"), F.col("n_b") - F.size("own_b"))
    open_ = stage(product(pairs.select("a", "b"), True).filter(reaches(met + rest)).select("a", "b", "n_a", "n_b", met.alias("met")), "met")
    more = product(open_.select("a", "b"), False).select("a", "b", "n_a", "n_b", met.alias("met"))
    overlap = open_.union(more).groupBy("a", "b", "n_a", "n_b").agg(F.sum("met").alias("overlap"))
    return overlap.filter(reaches(F.col("overlap"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): least labels of neighbours and jumps to labels' labels, until nothing changes."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
    both = stage(both.distinct(), "edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("jump"))
        new = stage(least.join(jump, "least").select("node", F.least("least", "jump").alias("component"), (F.least("least", "jump") != F.col("was")).alias("changed")), "labels")
        discard(labels)
        labels = new.select("node", "component")
        if new.filter("changed").isEmpty():
            discard(both)
            return labels


def told_apart(rows: DataFrame) -> DataFrame:
    """Classes are keyed by half of a 128-bit digest; where two sets share it, all but one get a key from both halves."""
    shared = rows.filter("node is not null").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least <> most")
    if shared.isEmpty():
        return rows.drop("check")
    key = F.when(F.col("least").isNull() | (F.col("check") == F.col("least")), F.col("node")).otherwise(F.xxhash64("node", "check"))
    return rows.join(shared, "node", "left").withColumn("node", key).drop("check", "least", "most")


def labelled(docs: DataFrame, k: int, percent: int, rounds: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n (size of the set), node (its class), first (the least doc_id and text hash of the component)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = told_apart(stage(profile(own, k, percent), "profile"))
    named = rows.filter("node is not null and doc_id is not null")
    classes = named.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("n").alias("n"))

    postings = named.filter("prefix is not null").select("node", "n", F.posexplode("prefix").alias("place", "shingle")).repartition("shingle")
    blocks = postings.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("n", "node").alias("hub_n")).filter("hub <> last").drop("last")
    links = stage(postings.join(blocks, "shingle").select("shingle", "node", "n", "hub", "hub_n").distinct(), "links")

    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    members = links.select("node").distinct()
    few = members.count() <= BROADCAST_ROWS
    wanted = classes.join(F.broadcast(members) if few else members, "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = own.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("node", "text")
    if not named.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():  # of repeated rows, one
        texts = texts.dropDuplicates(["node"])
    texts = stage(texts, "texts")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    hubs = links.filter((F.col("node") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(*pair("node", "hub")).distinct()
    tried = stage(hubs, "pairs")
    edges = stage(linked(tried, texts, k, percent), "edges")
    label = components(edges)
    passed = [links, texts, tried]
    for turn in range(rounds):
        open_ = spanning(links, label)
        if turn < rounds - 1:
            hub = open_.groupBy("shingle").agg(F.max(F.struct(F.xxhash64("node", "shingle", F.lit(turn)).alias("h"), "node", "n", "component")).alias("hub"))
            met = open_.join(hub, "shingle").filter((F.col("component") != F.col("hub.component")) & fits(F.col("n"), F.col("hub.n")))
            new = met.select(*pair(F.col("node"), F.col("hub.node"))).distinct()
        else:
            new = overlapping(open_, named.filter("parity is not null").select("node", "parity"), percent)
        new = stage(new.join(tried, ["a", "b"], "left_anti"), "pairs")
        passed += [open_, new]
        tried = tried.union(new)
        found = stage(linked(new, texts, k, percent), "edges")
        if not found.isEmpty():
            edges = edges.union(found)
            label = components(edges)

    discard(*passed)
    first = classes.select("node", "first").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = first.groupBy("component").agg(F.min("first").alias("first"))
    of_node = first.select("node", "component").join(least, "component").select("node", "first")
    return rows.drop("prefix", "parity").join(of_node, "node", "left")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to, itself included) of every document."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return labelled(docs, k, percent, rounds, doc_id, text).select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def spanning(links: DataFrame, label: DataFrame) -> DataFrame:
    """The links of blocks that span several components, with components; written, as two joins read them."""
    marked = links.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = marked.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low <> high").drop("low", "high")
    return stage(marked.join(several, "shingle").select("shingle", "node", "n", "component", "members"), "open")


def overlapping(open_: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs across components whose overlap can reach the bound. ``parities`` holds (node, parity) once or more.

    In large blocks a pair is formed once, at the least large block that has both, and the number of such blocks, with
    the small blocks of either, bounds its overlap inside both prefixes. All other common shingles lie behind the prefix
    that ends first, so that the overlap is at most that number plus what stands behind the longer rest. Small blocks, and
    nodes with very many shingles in large ones, do not carry lists along: their pairs are formed at every common shingle
    and put together afterwards. Members of large blocks carry their parity, which bounds the difference of the whole sets.
    """
    large = F.col("members") > SMALL_BLOCK
    own = open_.groupBy("node").agg(F.collect_set(F.when(large, F.col("shingle"))).alias("own"), F.count_if(~large).alias("few"))
    crowded = open_.filter(large).select("node").distinct()
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    own = own.join(parities.join(crowded, "node", "left_semi").dropDuplicates(["node"]), "node", "left")
    listed = F.when(large & (F.size("own") <= LISTED), F.col("own"))
    rows = stage(open_.join(own, "node").select("shingle", "node", "n", "component", "members", "few", listed.alias("own"), F.when(large, F.col("parity")).alias("parity")), "open")
    parts = F.ceil(F.col("members") / PART).cast("int")  # of a block: its members are dealt on one side, repeated on the other
    dealt = {"a": F.pmod(F.xxhash64("node"), parts).cast("int"), "b": F.explode(F.sequence(F.lit(0), parts - 1))}
    x, y = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in ("shingle", "node", "n", "component", "few", "own", "parity")), dealt[side].alias(f"part_{side}")) for side in "ab")
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    rest = F.ceil(F.lit(percent) * F.greatest("n_a", "n_b") / 100) - 1
    common = F.array_intersect("own_a", "own_b")
    listed = F.col("own_a").isNotNull() & F.col("own_b").isNotNull()
    enough = ~listed | (F.when(F.size(common) + F.least("few_a", "few_b") + rest >= need, F.array_min(common)) == F.col("shingle_a"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    possible = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & sizes & F.coalesce(enough, F.lit(False))
    near = (100 + percent) * unlike(F.col("parity_a"), F.col("parity_b")) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    possible &= F.coalesce(near, F.lit(True))
    met = x.join(y, (F.col("shingle_a") == F.col("shingle_b")) & (F.col("part_a") == F.col("part_b")) & possible)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all columns: the one of the least doc_id, and of its texts the one of the least
    hash. A doc_id with several texts counts as that many documents, equal rows as one; of rows that differ only in other
    columns the first in the order of their JSON stays. Rows without doc_id or shingles stay."""
    found = stage(labelled(docs, k, percent, 2, "doc_id", "text").filter("doc_id is not null and n > 0").select("doc_id", "text_hash", "first"), "components")
    chosen = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    key, mark = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("key", "mark"))  # names that no column has
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")))

    def of(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.struct("doc_id", "text_hash").alias(key))
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    kept = keyed.join(of(found.filter(~chosen).distinct()), key, "left_anti")
    again = found.filter(chosen).groupBy("doc_id", "text_hash").count().filter("count > 1")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = of(again)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = kept.join(again, key, "left_semi").groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(mark)).select(f"{mark}.*")
    return kept.join(again, key, "left_anti").select(*docs.columns).unionByName(first)
