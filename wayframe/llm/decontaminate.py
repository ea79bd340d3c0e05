"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words. Karp-Rabin hashes
of every ``min_match`` consecutive words of an item are its seeds; a document that
shares a seed with an item is a candidate of that item. For each candidate, running
Karp-Rabin greedy string tiling marks the longest common unmarked passages first,
then shorter ones, down to ``min_match`` words; the tiles never overlap, so an item
whose sentences were moved about is still covered. A document is contaminated when
the tiles cover at least ``threshold`` of an item's words.

A benchmark of at most ``broadcast_bytes`` of text, summed before anything is
collected, is sent to the tasks and the whole operator is one pass without a shuffle.
A larger one is joined: a bit filter of the items' seeds, of bounded size, drops most
of the documents' windows where they are made; the others meet the items' seeds by two
independent hashes, and each candidate pair is tiled from the places of its shared
windows, so no document's text is shuffled for it. Both ways decide alike.

Defined cases: null and empty texts have no words and are never contaminated, items
without words are ignored; an item shorter than ``min_match`` must occur whole;
equally long matches are taken by place in the item, then in the document; of items
with equal coverage the smallest id is the best one, null ids last; an item without an
id contaminates like any other and is listed as null; repeated items and repeated ids
are listed once; repeated rows are decided alike; very long texts are tiled whole, in
one row; an empty table gives an empty result, an empty benchmark contaminates nothing;
extra columns, whatever their names, are kept by ``clean`` and ignored by ``report``.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, filled, forget, unused

MIN_MATCH, THRESHOLD = 5, 0.8
BROADCAST_BYTES = 64 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so powers keep all 64 bits
WORD = re.compile(r"\w+")
DECISION = "contaminated boolean, item_ids array<long>, best_item long, coverage double, tiles int"
#: Bits of the seeds' filter for each seed, and at most (32 MB); decisions that may be broadcast.
FILTER_BITS, MOST_BITS, BROADCAST_DECISIONS = 16, 1 << 28, 500_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of the length, modulo 2**64."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # by doubling: the hash of 2k words from two hashes of k words
    value, have, out, taken = ids.astype(np.uint64), 1, None, 0
    bits, power = length, np.uint64(BASE)
    with np.errstate(over="ignore"):
        while True:
            if bits & 1:
                out = value[:n] if out is None else out * power + value[taken : taken + n]
                taken += have
            bits >>= 1
            if not bits:
                return out
            value = value[:-have] * power + value[have:]
            power *= power
            have *= 2


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, words) of running Karp-Rabin greedy string tiling."""
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), len(doc)))
    while True:
        queue = [(-size, i, d) for size, i, d in _matches(item, doc, free_i, free_d, length)]
        heapify(queue)
        while queue:
            size, i, d = heappop(queue)
            free = free_i[i : i - size] & free_d[d : d - size]
            if free.all():
                tiles.append((i, d, -size))
                free_i[i : i - size] = free_d[d : d - size] = False
                continue
            # what earlier tiles left of it waits its turn by its own length
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if hi - lo >= length:
                    heappush(queue, (lo - hi, i + lo, d + lo))
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


def _matches(item, doc, free_i, free_d, length) -> list[tuple[int, int, int]]:
    """Maximal common passages of unmarked words, of at least ``length`` words."""

    def open_windows(ids, free):
        run = np.concatenate([[0], np.cumsum(free)])
        if len(ids) < length:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(run[length:] - run[:-length] == length)

    at_i, at_d = open_windows(item, free_i), open_windows(doc, free_d)
    if not len(at_i) or not len(at_d):
        return []
    hash_i, hash_d = rolling(item, length)[at_i], rolling(doc, length)[at_d]
    at_d, hash_d = (x[np.isin(hash_d, hash_i)] for x in (at_d, hash_d))
    by_hash: dict[int, list[int]] = {}
    for i, h in zip(at_i.tolist(), hash_i.tolist()):
        by_hash.setdefault(h, []).append(i)
    out = []
    covered: dict[int, int] = {}  # on each diagonal, the end of the last match in the document
    for d, h in zip(at_d.tolist(), hash_d.tolist()):
        for i in by_hash[h]:
            if d < covered.get(d - i, -1) or not np.array_equal(item[i : i + length], doc[d : d + length]):
                continue
            size = length
            while i + size < len(item) and d + size < len(doc) and item[i + size] == doc[d + size] and free_i[i + size] and free_d[d + size]:
                size += 1
            covered[d - i] = d + size
            out.append((size, i, d))
    return out


class Benchmark:
    """The items as word numbers, with their seeds in one sorted array."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int, threshold: float):
        self.min_match, self.threshold = min_match, threshold
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        short: dict[int, list] = {}
        hashes, owners = [], []
        for item_id, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int64)
            if not len(ids):
                continue
            self.items.append((item_id, ids))
            if len(ids) < min_match:
                short.setdefault(len(ids), []).append(len(self.items) - 1)
            else:
                seeds = np.unique(rolling(ids, min_match))
                hashes.append(seeds)
                owners.append(np.full(len(seeds), len(self.items) - 1))
        self.short = {n: (np.concatenate([rolling(self.items[k][1], n) for k in ks]), ks) for n, ks in short.items()}
        seeds = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], (np.concatenate(owners)[order] if hashes else np.zeros(0, dtype=np.int64))

    def number(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def candidates(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Items that share a seed, with the places of the document's shared windows."""
        out: dict[int, list] = {}
        windows = rolling(ids, self.min_match)
        if len(windows) and len(self.seeds):
            known = np.concatenate([[0], np.cumsum(ids != 0)])
            places = np.flatnonzero(known[self.min_match :] - known[: -self.min_match] == self.min_match)
            lo = np.searchsorted(self.seeds, windows[places], "left")
            hi = np.searchsorted(self.seeds, windows[places], "right")
            for k in np.flatnonzero(hi > lo):
                for owner in self.owners[lo[k] : hi[k]].tolist():
                    out.setdefault(owner, []).append(int(places[k]))
        for n, (hashes, owners) in self.short.items():
            windows = rolling(ids, n)
            for h, owner in zip(hashes, owners):
                if len(at := np.flatnonzero(windows == h)):
                    out.setdefault(owner, []).extend(at.tolist())
        return {k: np.array(v) for k, v in out.items()}

    def decide(self, text: str | None):
        """Is the text contaminated, by which items, and the best item, its coverage and its number of tiles."""
        ids = self.number(text)
        hit, best = set(), (0.0, None, 0)
        for k, places in sorted(self.candidates(ids).items()) if len(ids) else ():
            item_id, item = self.items[k]
            least = min(self.min_match, len(item))
            # only words under shared windows can be tiled; a 0 parts what is not adjacent
            under = np.zeros(len(ids) + 1, dtype=bool)
            for j in range(least):
                under[places + j] = True
            kept = np.flatnonzero(under)
            coverage, tiles = _covered(item, ids[kept], kept, least)
            if coverage >= self.threshold:
                hit.add(item_id)
            if coverage > best[0]:
                best = (coverage, item_id, tiles)
        return bool(hit), sorted(hit, key=lambda i: (i is None, i)), best[1], best[0], best[2]


def _covered(item: np.ndarray, words_: np.ndarray, places: np.ndarray, least: int) -> tuple[float, int]:
    """The share of the item that tiles cover, and their number; ``words_`` stand at ``places`` of the document."""
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    tiles = greedy_tiles(item, np.insert(words_, gaps, 0), least)
    return sum(size for _, _, size in tiles) / len(item), len(tiles)


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("item_text")).distinct()


def _columns(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, text_col: str, min_match: int, threshold: float, out: str):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    rows = sorted(((r[0], r[1]) for r in _items(benchmark, item_id, item_text).collect()), key=order)
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    made: list[Benchmark] = []

    @F.pandas_udf(DECISION)
    def decide(texts: pd.Series) -> pd.DataFrame:
        if not made:
            forget()
            made.append(Benchmark(sent.value, min_match, threshold))
        names = [part.split(" ")[0] for part in DECISION.split(", ")]
        return pd.DataFrame([made[0].decide(t) for t in texts], columns=names).astype({"contaminated": bool, "best_item": "Int64", "tiles": "int32", "coverage": "float64"})

    return docs.withColumn(out, decide(F.col(f"`{text_col}`")))


def hashes(text: str | None, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of a text's words."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words(text)], dtype=np.uint64)


def windows(text: str | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all windows of the length."""
    return rolling(hashes(text), length), rolling(hashes(text, 1), length)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _seed_rows(keys, texts, lengths, bits):
    """``keys`` columns, then the length, place and hashes of all windows that pass the filter ``bits``."""
    rows, sizes, places, one, two = [], [], [], [], []
    for n, text in enumerate(texts):
        for length in lengths(text):
            first, second = windows(text, length)
            at = np.arange(len(first))
            if bits is not None and len(first):
                spot = first & np.uint64(8 * len(bits) - 1)
                at = np.flatnonzero(bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
            rows.append(np.full(len(at), n))
            sizes.append(np.full(len(at), length, dtype=np.int32))
            places.append(at.astype(np.int64))
            one.append(first[at])
            two.append(second[at])
    join = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts]).astype(kind)
    taken = pa.array(join(rows, np.int64))
    return [*[k.take(taken) for k in keys], pa.array(join(sizes, np.int32)), pa.array(join(places, np.int64)), _signed(join(one, np.uint64)), _signed(join(two, np.uint64))]


def _joined(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, text_col: str, min_match: int, threshold: float, out: str):
    """The same decisions for a benchmark of any size."""
    context = docs.sparkSession.sparkContext
    columns = ["length", "place", "h1", "h2"]
    types = "length int, place long, h1 long, h2 long"

    def item_seeds(batches):
        for batch in batches:
            of = lambda text: [min(min_match, n)] if (n := len(words(text))) else []
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(_seed_rows([batch.column(0), batch.column(2), batch.column(1)], texts, of, None), names=["item", "item_key", "item_text", *columns])

    # items are told apart by id and text; a hash of both stands for them
    items = _items(benchmark, item_id, item_text).withColumn("item_key", F.sha2(F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("-")), filled("item_text")), 256))
    items = checkpointed(items)
    seeds = items.select("item", "item_text", "item_key").mapInArrow(item_seeds, f"item long, item_key string, item_text string, {types}")
    seeds = checkpointed(seeds.select("item_key", "length", "h1", "h2").distinct())
    lengths = sorted(r[0] for r in seeds.select("length").distinct().collect())  # at most ``min_match``
    count = seeds.count()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (count * FILTER_BITS).bit_length()))
    spot = F.col("h1").bitwiseAND(F.lit(size - 1))
    set_bits = seeds.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    filled_words = np.zeros(size // 64, dtype=np.int64)
    for rows in set_bits.toArrow().to_batches():  # one row per word of the bounded filter
        filled_words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    sent = context.broadcast(filled_words.view(np.uint8))

    def doc_seeds(batches):
        bits = sent.value
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time bounds the windows held
                part = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(_seed_rows([part.column(0), part.column(1)], [part.column(2)[0].as_py()], lambda _: lengths, bits), names=["k1", "k2", *columns])

    @F.pandas_udf("coverage double, tiles int")
    def tiles_of(texts: pd.Series, places: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        found = []
        for text, at, first in zip(texts, places, firsts):
            names: dict[str, int] = {}
            item = np.array([names.setdefault(w, len(names) + 1) for w in words(text)], dtype=np.int64)
            least = min(min_match, len(item))
            start = {h: k for k, h in reversed(list(enumerate(rolling(hashes(text), least).view(np.int64).tolist())))}
            ids: dict[int, int] = {}
            for place, h in zip(at.tolist(), first.tolist()):
                k = start[h]
                ids.update((place + j, int(item[k + j])) for j in range(least))
            kept = np.array(sorted(ids), dtype=np.int64)
            found.append(_covered(item, np.array([ids[p] for p in kept.tolist()], dtype=np.int64), kept, least))
        return pd.DataFrame(found, columns=["coverage", "tiles"]).astype({"tiles": "int32"})

    k1, k2 = unused(docs, "__k1"), unused(docs, "__k2")
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(text, F.lit("text")), k2: F.xxhash64(F.lit("again"), text)})  # equal texts are tiled once
    hits = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text")).mapInArrow(doc_seeds, f"k1 long, k2 long, {types}")
    shared = hits.join(seeds, ["length", "h1", "h2"]).select("k1", "k2", "item_key", "place", "h1").distinct()
    pairs = shared.groupBy("k1", "k2", "item_key").agg(F.collect_list(F.struct("place", "h1")).alias("s"))
    done = pairs.join(items, "item_key").withColumn("t", tiles_of("item_text", F.col("s.place"), F.col("s.h1")))
    first = F.struct(-F.col("t.coverage"), F.col("item").isNull(), F.col("item"), F.col("item_text"))
    hit = F.when(F.col("t.coverage") >= threshold, F.struct("item"))
    found = done.groupBy("k1", "k2").agg(F.collect_set(hit).alias("hits"), F.min_by(F.struct("item", "t"), first).alias("b"))
    ids = F.array_sort(F.transform("hits", lambda x: F.struct(x["item"].isNull().alias("none"), x["item"].alias("item"))))
    found = found.select(
        F.col("k1").alias(k1), F.col("k2").alias(k2),
        F.struct((F.size("hits") > 0).alias("contaminated"), F.transform(ids, lambda x: x["item"]).alias("item_ids"), F.col("b.item").alias("best_item"), F.col("b.t.coverage").alias("coverage"), F.col("b.t.tiles").alias("tiles")).alias(out),
    )
    found = checkpointed(found)
    if found.count() <= BROADCAST_DECISIONS:
        found = F.broadcast(found)
    return keyed.join(found, [k1, k2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], out)


def tiled(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_match: int = MIN_MATCH, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES, out: str = "tiling",
) -> DataFrame:
    """``docs`` with a struct column ``out`` (item_ids, best_item, coverage, tiles)."""
    size = benchmark.agg(F.sum(F.octet_length(f"`{item_text}`") + 64)).first()[0] or 0
    run = _columns if size <= broadcast_bytes else _joined
    return run(docs, benchmark, item_id, item_text, text_col, min_match, threshold, out)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, contaminated, item_ids, best_item, coverage, tiles`` for every row."""
    rows = tiled(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{options.get('text_col', 'text')}`").alias("text")), benchmark, **(options | {"text_col": "text"}))
    none = F.array().cast("array<bigint>")
    return rows.select(
        "doc_id", F.coalesce(F.col("tiling.contaminated"), F.lit(False)).alias("contaminated"), F.coalesce(F.col("tiling.item_ids"), none).alias("item_ids"), F.col("tiling.best_item").alias("best_item"),
        F.round(F.coalesce(F.col("tiling.coverage"), F.lit(0.0)), 6).alias("coverage"), F.coalesce(F.col("tiling.tiles"), F.lit(0)).alias("tiles"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without its contaminated rows; columns unchanged."""
    out = unused(docs, "tiling")
    rows = tiled(docs, benchmark, out=out, **options)
    return rows.where(~F.coalesce(F.col(f"`{out}`.contaminated"), F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])
