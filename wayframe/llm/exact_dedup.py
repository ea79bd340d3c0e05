"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by byte length, the survivors by a hash of their first
characters, and only rows that still share both with another row have their
full content hashed. Every level is a partially aggregated count, so a group
that holds a third of all rows costs one counter per task.

While a level's surviving keys, counted first, are at most ``prune_rows``, they are
broadcast and the level prunes in the tasks that scan. Beyond it narrow rows meet
their keys in a shuffled semi-join; before the last level, which needs the texts, a
blocked Bloom filter of the keys (of at most 36 MB) first keeps most texts of no
survivor out of that shuffle. No level is ever skipped.

Defined cases: null text equals the empty text; very long texts are hashed whole, in
one row; repeated rows with one id count in the group's size and share their decision;
a group whose ids are all null has a null ``keep_id`` and keeps all its rows; extra
columns, whatever their names, are ignored by ``exact_dedup`` and kept by
``drop_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BLOCKS, bloom_hits, bloom_table, checkpointed, filled, unused

#: Surviving keys of 20 bytes that a pruning level may broadcast (40 MB).
PRUNE_ROWS = 2_000_000
#: Characters that the second level hashes.
PREFIX_CHARS = 128


def _alive(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The keys that occur at least twice, and their number."""
    alive = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys))
    return alive, alive.count()


def _length(text_col: str):
    return F.octet_length(filled(f"`{text_col}`"))


def _head(text_col: str, prefix_chars: int):
    return F.xxhash64(F.substring(filled(f"`{text_col}`"), 1, prefix_chars))


def _survivors(docs: DataFrame, text_col: str, prefix_chars: int, prune_rows: int) -> tuple[DataFrame, int]:
    """Pairs ``__len, __head`` that the first two levels leave, and their number."""
    rows = docs.select(_length(text_col).alias("__len"), F.substring(filled(f"`{text_col}`"), 1, prefix_chars).alias("__start"))
    lengths, count = _alive(rows, ["__len"])
    rows = rows.join(F.broadcast(lengths) if count <= prune_rows else lengths, "__len", "left_semi")
    return _alive(rows.select("__len", F.xxhash64("__start").alias("__head")), ["__len", "__head"])


def _parts(docs: DataFrame, text_col: str, prefix_chars: int, prune_rows: int, alive: DataFrame, count: int) -> tuple[DataFrame, DataFrame | None, str]:
    """``docs`` with a column, named third, that holds the full hash of survivors of both levels and is null otherwise.

    Beyond the broadcast bound the first table holds what may survive, the second what can't.
    """
    size, head, found, maybe, sha = (unused(docs, n) for n in ("__len", "__head", "__found", "__maybe", "__sha"))
    keyed = docs.withColumns({size: _length(text_col), head: _head(text_col, prefix_chars)})
    keys = alive.select(F.col("__len").alias(size), F.col("__head").alias(head), F.lit(True).alias(found))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    full = F.when(F.col(found), F.sha2(filled(f"`{text_col}`"), 256)).alias(sha)
    if count <= prune_rows:
        return keyed.join(F.broadcast(keys), [size, head], "left").select(*columns, full), None, sha
    bloom, blocks = bloom_table(keys, [size, head], count, BROADCAST_BLOCKS)
    probed = bloom_hits(keyed, [size, head], bloom, blocks, maybe)
    passed = probed.where(~F.col(maybe)).select(*columns, F.lit(None).cast("string").alias(sha))
    return probed.where(maybe).join(keys, [size, head], "left").select(*columns, full), passed, sha


def _grouped(rows: DataFrame, id_col: str, text_col: str, sha: str) -> DataFrame:
    """Texts that occur more than once among hashed rows: ``sha256, keep_id, group_size``."""
    full = rows.where(F.col(sha).isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.col(sha).alias("sha256"))
    return full.groupBy("sha256").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, prune_rows: int | None = None
) -> DataFrame:
    """One row per text that occurs more than once: ``sha256``, ``keep_id`` (largest id), ``group_size``."""
    prune_rows = PRUNE_ROWS if prune_rows is None else prune_rows
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    alive, count = _survivors(docs, text_col, prefix_chars, prune_rows)
    rows, _, sha = _parts(docs, text_col, prefix_chars, prune_rows, alive, count)
    return _grouped(rows, id_col, text_col, sha)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A decision per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = copy_groups(docs, id_col, text_col).withColumnRenamed("sha256", "text_sha256")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(filled(text_col), 256).alias("text_sha256"))
    joined = rows.join(groups.withColumn("__copied", F.lit(True)), "text_sha256", "left")
    keep = F.when(F.col("__copied"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, prune_rows: int | None) -> tuple[DataFrame, str]:
    """``docs`` without the rows that are not kept, with their texts' hash if the text is copied, and that column's name.

    Only survivors of both levels have their texts hashed.
    """
    prune_rows = PRUNE_ROWS if prune_rows is None else prune_rows
    alive, count = _survivors(docs, text_col, PREFIX_CHARS, prune_rows)
    hashed, passed, sha = _parts(docs, text_col, PREFIX_CHARS, prune_rows, alive, count)
    keep, copied = unused(docs, "__keep"), unused(docs, "__copied")
    groups = checkpointed(_grouped(hashed, id_col, text_col, sha).select(F.col("sha256").alias(sha), F.col("sha256").alias(copied), F.col("keep_id").alias(keep)))
    alone = None
    if groups.count() <= prune_rows:
        groups = F.broadcast(groups)
    else:  # rows without a hash must not meet in one task
        alone = hashed.where(F.col(sha).isNull())
        hashed = hashed.where(F.col(sha).isNotNull())
    lost = F.col(keep).isNotNull() & ~F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = hashed.join(groups, sha, "left").where(~lost).select(*columns, copied)
    for other in (alone, passed):
        if other is not None:
            marked = marked.unionByName(other.select(*columns, F.lit(None).cast("string").alias(copied)))
    return marked, copied


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prune_rows: int | None = None) -> DataFrame:
    """``docs`` without the rows that are not kept; columns unchanged.

    Groups are broadcast while their counted number is bounded, so texts are not
    shuffled; beyond it Spark joins by sorting and splits hot keys.
    """
    marked, copied = _marked(docs, id_col, text_col, prune_rows)
    return marked.drop(copied)


def one_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prune_rows: int | None = None) -> DataFrame:
    """Exactly one row of each text: of the rows that ``drop_copies`` leaves of a group, the least by all columns.

    Differs from ``drop_copies`` where rows repeat an id or have none. All columns must be orderable.
    """
    marked, copied = _marked(docs, id_col, text_col, prune_rows)
    rows = marked.where(F.col(copied).isNotNull()).groupBy(copied).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return marked.where(F.col(copied).isNull()).drop(copied).unionByName(rows.select("row.*"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id,
             CASE WHEN COUNT(*) OVER w > 1 THEN MAX(doc_id) OVER w ELSE doc_id END AS keep_id,
             CAST(COUNT(*) OVER w AS BIGINT) AS group_size,
             text_sha256
      FROM (SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256 FROM documents)
      WINDOW w AS (PARTITION BY text_sha256))
"""
