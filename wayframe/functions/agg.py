"""Aggregates: exact percentiles, ordered lists, weighted means and medians, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_cont(value: Column, share: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(value, F.lit(share))


def weighted_sum(weight: Column) -> Column:
    """Sum with nothing for null weights, and 0 for no rows."""
    return F.coalesce(F.sum(weight), F.lit(0.0))


def ordered_list(value: Column, *keys: Column) -> Column:
    """Values, nulls included, in the order of the keys."""
    rows = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def first_by(value: Column, *keys: Column) -> Column:
    return F.min_by(value, F.struct(*keys))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.nullif(F.sum(weight), F.lit(0.0)))


def only_one(value: Column, when: Column) -> Column:
    """The value where the condition holds, if it holds for exactly one row of the group."""
    return F.when(F.count_if(when) == 1, F.max(F.when(when, value)))


def index_percentile(value: Column, share: float) -> Column:
    """Percentile by index floor((n - 1) * share), without interpolation."""
    ordered = F.array_sort(F.collect_list(value))
    return F.try_element_at(ordered, (F.floor((F.size(ordered) - 1) * share) + 1).cast("int"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """Per group the first value, by value then ``tie``, whose cumulative weight reaches half of the total.

    Rows are pre-aggregated per value and tie, so repeats cost nothing in the window.
    """
    rows = rows.groupBy(*keys, value, tie).agg(F.sum(weight).alias("__w"))
    order = Window.partitionBy(*keys).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("__run", F.sum("__w").over(order)).withColumn("__all", F.sum("__w").over(Window.partitionBy(*keys)))
    return ranked.where("__run >= __all / 2").groupBy(*keys).agg(F.min_by(value, F.struct(value, tie)).alias(value))


def set_fingerprint(*values: Column) -> Column:
    """Order-independent fingerprint of a set's rows: the XOR of their SHA-256 digests, in hexadecimal."""
    digest = F.sha2(F.to_json(F.struct(*values)).cast("binary"), 256)
    # 32 bits at a time, which no signed integer cuts short
    parts = [F.bit_xor(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    return F.concat(*[F.lpad(F.lower(F.hex(part)), 8, "0") for part in parts])


def ordered_fingerprint(*values: Column) -> Column:
    """SHA-256 of a group's rows in their own order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*values)))).cast("binary"), 256)
