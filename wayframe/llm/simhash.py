"""SimHash near-duplicate components by anchor-point covering.

A text's fingerprint is the bitwise majority of the hashes of its three-word shingles.
Distinct fingerprints meet at anchors, the words of a covering code: a product of
perfect codes, the [23, 12] Golay code (covering radius 3) on bits 0 to 22 and on bits
23 to 45, and for very many fingerprints also the [15, 11] Hamming code (radius 1) on
bits 46 to 60. Every fingerprint has exactly one anchor within the covering radii, its
home. It is also sent to every anchor that it can reach by going beyond the radii by at
most the threshold in all, which is where each fingerprint within the threshold has its
home, since a step of one bit goes beyond one radius by one at most. Comparing homes
with visitors at each anchor therefore finds every link.

A fingerprint has at most 1 + 64 + 2016 fingerprints within two bits, so links grow
with the number of distinct fingerprints, not with the square of a group's size;
copies share one fingerprint and are folded before. Links become components by
alternating large and small stars, with a checkpoint for each round; nothing but
counts reaches the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other;
fewer than three words are one shingle; a bit set in exactly half the hashes is 0;
very long texts are read whole, in one row; repeated rows share a component; a component
whose ids are all null has a null id; an empty table gives an empty result; extra columns,
whatever their names, are ignored by ``components`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, forget_driver, kept, unused

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Distinct fingerprints above which the third block joins the code.
THIRD_BLOCK_ABOVE = 50_000_000
#: Blocks: first bit, length, generator polynomial, covering radius.
GOLAY, HAMMING = (23, 0b110001110101, 3), (15, 0b10011, 1)


# fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text."""
    import xxhash

    # bytes.lower and bytes.split know only ASCII letters and white space
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 255 * 64):  # 255 rows of single bits fit a byte
        part = hashes[k : k + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        rows = -(-len(bits) // 255) * 255
        if rows != len(bits):
            bits = np.concatenate([bits, np.zeros((rows - len(bits), 8), dtype=np.uint64)])
        count += bits.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: fingerprints as signed 64-bit integers."""

    def run(batches):
        forget()
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# anchors


class Code:
    """A perfect cyclic code: for each syndrome, the patterns that lead to a code word, by excess over the radius."""

    def __init__(self, length: int, polynomial: int, radius: int, threshold: int):
        degree = polynomial.bit_length() - 1
        self.length = length
        single = []
        for bit in range(length):
            rest = 1 << bit
            while rest.bit_length() > degree:
                rest ^= polynomial << (rest.bit_length() - 1 - degree)
            single.append(rest)
        half = length // 2
        self.half = half
        self.low, self.high = (self._syndromes(single[a:b]) for a, b in ((0, half), (half, length)))
        self.lists = []
        for excess in range(threshold + 1):
            weights = range(radius + 1) if not excess else [radius + excess]
            found: list[list[int]] = [[] for _ in range(1 << degree)]
            for weight in weights:
                for bits in combinations(range(length), weight):
                    syndrome = 0
                    for b in bits:
                        syndrome ^= single[b]
                    found[syndrome].append(sum(1 << b for b in bits))
            sizes = np.array([len(x) for x in found])
            self.lists.append((np.concatenate([[0], np.cumsum(sizes)]), np.array([p for x in found for p in x], dtype=np.uint64)))

    @staticmethod
    def _syndromes(single: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(single), dtype=np.int64)
        for bit, s in enumerate(single):
            out[1 << bit : 2 << bit] = out[: 1 << bit] ^ s
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[(words & np.uint64((1 << self.half) - 1)).astype(np.int64)] ^ self.high[(words >> np.uint64(self.half)).astype(np.int64)]


class Anchors:
    def __init__(self, blocks: int, threshold: int = THRESHOLD):
        shapes = [GOLAY, GOLAY, HAMMING][:blocks]
        codes = {s: Code(*s, threshold) for s in set(shapes)}
        self.codes, self.threshold = [codes[s] for s in shapes], threshold

    def visits(self, fps: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``fps`` and anchors at exactly the excess over the covering radii in all."""
        places, anchors = [], []
        for shares in self._shares(len(self.codes), excess):
            row, anchor, shift = np.arange(len(fps)), np.zeros(len(fps), dtype=np.uint64), 0
            for code, share in zip(self.codes, shares):
                starts, patterns = code.lists[share]
                words = fps[row] >> np.uint64(shift) & np.uint64((1 << code.length) - 1)
                syndromes = code.syndrome(words)
                sizes = starts[syndromes + 1] - starts[syndromes]
                take = np.repeat(starts[syndromes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                anchor = np.repeat(anchor, sizes) | (np.repeat(words, sizes) ^ patterns[take]) << np.uint64(shift)
                row = np.repeat(row, sizes)
                shift += code.length
            places.append(row)
            anchors.append(anchor)
        return np.concatenate(places), np.concatenate(anchors)

    @classmethod
    def _shares(cls, blocks: int, excess: int):
        if blocks == 1:
            yield (excess,)
            return
        for first in range(excess + 1):
            for rest in cls._shares(blocks - 1, excess - first):
                yield (first, *rest)


def at_anchors(distinct: DataFrame, blocks: int, threshold: int, home: bool) -> DataFrame:
    """``anchor, fp``: each fingerprint at its home, or at all anchors that it visits."""

    def run(batches):
        code = kept(("anchors", blocks, threshold), lambda: Anchors(blocks, threshold))
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 4096):
                part = values[k : k + 4096]
                for excess in range(1 if home else threshold + 1):
                    places, anchors = code.visits(part, excess)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(part[places].view(np.int64))], names=["anchor", "fp"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long")


def links(distinct: DataFrame, count: int, threshold: int = THRESHOLD) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints at most ``threshold`` bits apart, each once."""
    blocks = 3 if count > THIRD_BLOCK_ABOVE else 2
    home = at_anchors(distinct, blocks, threshold, True).select("anchor", F.col("fp").alias("a"))
    visit = at_anchors(distinct, blocks, threshold, False).select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return visit.join(home, (visit.anchor == home.anchor) & near & (F.col("a") < F.col("b"))).select("a", "b")


# components


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges; ``root`` is the smallest node of its component.

    Large star: each node's larger neighbours go to its smallest neighbour; small star:
    its smaller ones do. Both keep components and end in stars, in logarithmic rounds.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        forget_driver(edges.sparkSession)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(distinct, distinct.count(), threshold)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp")  # only fingerprints with links
    ids = named.groupBy("root").agg(F.min("least").alias("id"))
    found = named.join(ids, "root").select("fp", "id")
    per_fp = checkpointed(distinct.join(found, "fp", "left").select("fp", F.coalesce("id", "least").alias("component_id")))
    return rows.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Dropped ids of 8 bytes that may be broadcast (16 MB).
BROADCAST_IDS = 2_000_000


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, similarity: float | None = None) -> DataFrame:
    """``docs`` with the smallest id of every component only (rows without an id stay); columns unchanged.

    With ``similarity``, texts link by the Jaccard similarity of their five-word shingles besides:
    texts of 0.8 differ in about 10 of 64 bits and up to 18, and no covering code reaches that far
    with a bearable number of anchors, so ``similar`` adds those links to the fingerprints' own.
    """
    found = components(docs, id_col, text_col, threshold).select("doc_id", "component_id")
    if similarity is not None:
        from .similar import components as similar_components

        found = found.union(similar_components(docs, id_col, text_col, similarity=similarity))
        # both kinds of links form components together
        found = connected(found.where("doc_id <> component_id"), "doc_id", "component_id").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    name = unused(docs, "__gone")
    gone = checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
