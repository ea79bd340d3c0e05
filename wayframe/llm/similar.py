"""Near-duplicate components by exact Jaccard similarity of shingle sets.

A text's set holds the 64-bit hashes of its five-word shingles. Two sets of similarity t
or more share a shingle among the first ``n - ceil(t n) + 1`` of each in any common order
(prefix filtering), so comparing the texts that meet at a prefix shingle finds every link.
The order puts shingles that are frequent in a sample last, which changes the work only.

The comparisons go in two steps. At each shingle all texts are first compared with a
leader, which links large groups at a cost in proportion to their size; then, at the
shingles where several components still meet, every pair from different components is, unless
one of the few shingles that each had just before is the same: then the pair met there, and the
first shingle that two texts share is never passed over.
Pairs within one component need no comparison. A candidate is dropped early only where sizes,
places in the order or parity maps rule the similarity out (each element flips one bit of the
map, so maps differ in no more bits than sets in elements); the others are verified on whole sets.
Where all pairs of a shingle meet, a small map already takes part in their join; a larger one, of
about two bits an element, then spares most texts that are not similar the way to a comparison.

Defined cases: words are separated by ASCII white space and compared in ASCII lower case;
fewer words than a shingle are one shingle; null and empty texts have the empty set and
are copies of each other; very long texts are read whole, in one row; repeated rows and
rows without an id link like any other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget
from .simhash import connected

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Documents sampled for the order, and frequent shingles kept from them.
ORDER_DOCS, ORDER_SHINGLES = 5_000, 200_000
#: Alive shingles that may be broadcast; leaders that a shingle's texts are dealt to, by the shingle.
BROADCAST_KEYS, LEADERS = 2_000_000, 8
#: Comparisons of one set that one copy of it serves.
SHARE = 256
#: Texts whose sets are held at once.
ROWS = 1024
#: 64-bit words of a set's small parity map; bits of the large one for each element.
PARITY, SKETCH_BITS = 8, 2
#: Shared shingles before each that a place remembers.
TAIL = 4


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(words.tobytes(), SEED)], dtype=np.uint64)
    n, hashes = len(words) - shingle + 1, np.zeros(len(words) - shingle + 1, dtype=np.uint64)
    for k in range(shingle):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(hashes ^ hashes >> np.uint64(32))


def _prefix(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _frequent(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several sampled documents, sorted, and their counts."""
    count = docs.count()
    share = min(1.0, ORDER_DOCS / max(count, 1))

    def run(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["key"])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    rows = sample.mapInArrow(run, "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(ORDER_SHINGLES).toPandas()
    keys, counts = rows["key"].to_numpy(dtype=np.int64).view(np.uint64), rows["count"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def parity_map(s: np.ndarray, words: int) -> np.ndarray:
    """The parity of the elements at each of the map's bits, as 64-bit words; ``words`` is a power of two.

    Folding a map's halves into each other by XOR gives the map of half the length.
    """
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity map whose length follows the set's size."""
    return parity_map(s, 1 << max(0, (SKETCH_BITS * len(s) - 1) // 64).bit_length())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _set_hash(whole: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(whole, SEED)


def prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, fp, size, parity, sketch, prefix`` for every row: the set's hash, size, parity maps and first shingles in the common order."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col, shingle))

    def run(batches):
        forget()
        keys, counts = frequent.value
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sets, firsts = [shingles(t.as_py(), shingle) for t in batch.column(2)], []
            for s in sets:
                n = np.zeros(len(s), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    n = np.where(keys[at] == s, counts[at], 0)
                firsts.append(s[np.lexsort((s, n))[: _prefix(len(s), similarity)]].view(np.int64))
            fps = np.array([_set_hash(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in firsts])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
            maps = [pa.array(m, pa.list_(pa.int64())) for m in ([parity_map(s, PARITY) for s in sets], [sketch(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), *maps, prefix],
                names=["doc_id", "text_hash", "fp", "size", "parity", "sketch", "prefix"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, fp long, size int, parity array<long>, sketch array<long>, prefix array<long>")


def _possible(a: str, b: str, similarity: float):
    """Can two sets that meet at these places of their orders be similar enough?"""
    size = lambda f: F.col(f"{f}.size")
    rest = lambda f: F.col(f"{f}.size") - F.col(f"{f}.pos")
    long_enough = F.least(size(a), size(b)) >= F.greatest(size(a), size(b)) * similarity - 1e-9
    # what precedes the place may be shared too, so the common part is bounded from both sides
    shared = F.least(rest(a), rest(b)) + F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos"))
    return long_enough & (shared >= (size(a) + size(b)) * (similarity / (1 + similarity)) - 1e-6)


def _allowed(size_a: str, size_b: str, similarity: float):
    """Elements in which similar sets may differ at most."""
    return (F.col(size_a) + F.col(size_b)) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _near(a: str, b: str, similarity: float):
    """Do the small parity maps leave the similarity possible?"""
    differ = sum((F.bit_count(F.col(f"{a}.parity")[k].bitwiseXOR(F.col(f"{b}.parity")[k])) for k in range(PARITY)), F.lit(0))
    return differ <= _allowed(f"{a}.size", f"{b}.size", similarity)


def _folded_difference(a: str, b: str):
    """Bits in which two parity maps differ, the longer one folded to the shorter."""
    words = F.least(F.size(a), F.size(b))

    def fold(name: str, at):
        places = F.sequence(F.lit(0), F.floor((F.size(name) / words)).cast("int") - 1)
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.element_at(F.col(name), at + k * words + 1)))

    differ = F.transform(F.sequence(F.lit(0), words - 1), lambda at: F.bit_count(fold(a, at).bitwiseXOR(fold(b, at))))
    return F.aggregate(differ, F.lit(0), lambda acc, n: acc + n)


def _bounded(keys: DataFrame) -> DataFrame:
    """``keys``, written, and broadcast where they are used if they are few enough."""
    keys = checkpointed(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def sketched(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` that the parity maps of ``rows`` leave possible."""
    pairs = checkpointed(pairs)
    needed = _bounded(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    maps = rows.select("fp", "size", "sketch").join(needed, "fp", "left_semi").dropDuplicates(["fp"])
    for side in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("fp").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "sketch")]), side)
    return pairs.where(_folded_difference("sketch_a", "sketch_b") <= _allowed("size_a", "size_b", similarity)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose sets have the similarity; ``texts`` has one ``text`` for each ``fp``.

    Texts travel, as they are smaller than their sets. One that takes part in many pairs is copied
    for every ``SHARE`` of them, so that no task gets all pairs of one text.
    """
    needs = {side: pairs.groupBy(F.col(side).alias("fp")).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies")) for side in "ab"}
    for side, other in ("ab", "ba"):
        need = needs[side]
        dealt = texts.join(need, "fp").select(F.col("fp").alias(side), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias(f"text_{side}"))
        pairs = pairs.join(need.withColumnRenamed("fp", side), side).withColumn("copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
        pairs = pairs.join(dealt, [side, "copy"]).drop("copy")

    def run(batches):
        forget()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingles(x.as_py(), shingle), shingles(y.as_py(), shingle)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` for every row: texts linked by chains of similar pairs, named by the smallest id."""
    rows = checkpointed(prefixes(docs, id_col, text_col, shingle, similarity))
    hashes = rows.groupBy("fp").agg(F.min("text_hash").alias("text_hash"))

    def similar_ones(pairs: DataFrame) -> DataFrame:
        needed = _bounded(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(hashes, "fp"))
        texts = _rows(docs, id_col, text_col).join(needed, "text_hash").groupBy("fp").agg(F.min("text").alias("text"))
        return checkpointed(verified(pairs, texts, shingle, similarity))

    entries = rows.select("fp", "size", "parity", F.posexplode("prefix").alias("pos", "key"))
    alive = _bounded(entries.groupBy("key").count().where("count > 1").select("key"))
    shared = entries.join(alive, "key").groupBy("fp", "size").agg(F.array_sort(F.collect_set(F.struct("pos", "key"))).alias("shared"), F.first("parity").alias("parity"))  # as long as one text at most
    before = F.slice(F.transform("shared", lambda n: n["key"]), F.greatest(F.col("k") - TAIL, F.lit(0)) + 1, F.least(F.col("k"), F.lit(TAIL)))
    each = shared.select("fp", "size", "parity", "shared", F.posexplode("shared").alias("k", "n")).select("n.key", F.struct("fp", "size", "n.pos", before.alias("before"), "parity").alias("e"))
    met = checkpointed(each)

    turn = F.xxhash64("e.fp", F.pmod("key", F.lit(LEADERS))).alias("turn")
    places = met.select("key", F.struct("e.fp", "e.size", "e.pos").alias("e"))
    leads = places.groupBy("key").agg(F.min(F.struct(turn, "e.fp", "e.size", "e.pos")).alias("lead"))
    led = places.join(leads, "key").where((F.col("e.fp") != F.col("lead.fp")) & _possible("e", "lead", similarity))
    led = led.select(F.least("e.fp", "lead.fp").alias("a"), F.greatest("e.fp", "lead.fp").alias("b")).distinct()
    led = checkpointed(sketched(led, rows, similarity))
    edges = similar_ones(led)
    roots = connected(edges)

    # what several components still share
    rooted = met.join(_bounded(roots.select(F.col("node").alias("fp"), "root")), F.col("e.fp") == F.col("fp"), "left").select("key", F.coalesce("root", "e.fp").alias("root"), "e")
    mixed = _bounded(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
    rooted = rooted.join(mixed, "key")
    one, two = rooted.select("key", F.col("root").alias("r1"), F.col("e").alias("one")), rooted.select("key", F.col("root").alias("r2"), F.col("e").alias("two"))
    again = F.arrays_overlap("one.before", "two.before")
    cross = one.join(two, "key").where((F.col("r1") < F.col("r2")) & ~again & _possible("one", "two", similarity) & _near("one", "two", similarity))
    cross = cross.select(F.least("one.fp", "two.fp").alias("a"), F.greatest("one.fp", "two.fp").alias("b"))
    cross = checkpointed(sketched(cross.distinct().join(led, ["a", "b"], "left_anti"), rows, similarity))
    more = similar_ones(cross)
    if not more.isEmpty():
        roots = connected(edges.union(more))

    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = named.join(ids, "root").select("fp", "component_id")
    return rows.select("doc_id", "fp").join(per_fp, "fp").select("doc_id", "component_id")
