"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import reduce
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import checkpointed, shared_folder

__all__ = ["bloom_hits", "bloom_table", "checkpointed", "filled", "forget", "forget_driver", "kept", "shared_folder", "shuffle_partitions", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(column: str):
    """The text with null read as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


#: What a Python worker keeps between tasks. Workers live on through the stages of a pipeline. A nested function is sent
#: with a copy of the globals that it names, so a dictionary beside it would be empty again in every task.
_KEPT: dict[Any, Any] = {}


def forget() -> None:
    """Gives back what earlier tasks left in this worker, to the system too."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # glibc only


#: The JVM's command for it.
TRIM = "systemTrimNativeHeap"


def forget_driver(spark: SparkSession) -> bool:
    """Gives back to the system what the driver's JVM has freed outside its heap; tells whether it could.

    Every exchange takes a thread of its own for a minute, and many rounds of small jobs leave the C library's arenas of
    all those threads behind. A JVM that has no such command is left as it is.
    """
    try:
        jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        kind, thing, text = jvm.java.lang.Class.forName, jvm.java.lang.Object, jvm.java.lang.String
        kinds, values = array(jvm.java.lang.Class, 4), array(thing, 4)
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        for k, (of, value) in enumerate([("javax.management.ObjectName", name), ("java.lang.String", TRIM), ("[Ljava.lang.Object;", array(thing, 0)), ("[Ljava.lang.String;", array(text, 0))]):
            kinds[k], values[k] = kind(of), value
        # by the interface's method, as the server's own class is not open to reflection
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
        return True
    except (AttributeError, Py4JError):  # no classic session, or no such command
        return False


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """The worker's object of that name, made if it is not the one that it keeps; it keeps one at a time."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


#: Blocked Bloom filters: bits per key, bits set per key, words of 64 bits per block.
BITS_PER_KEY, PROBES, WORDS = 16, 6, 8
#: Blocks of 72 bytes that may be broadcast (36 MB).
BROADCAST_BLOCKS = 500_000


def _block(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks))


def _masks(keys: list[Column]) -> list[Column]:
    """The bits of a key inside its block, as one mask per word."""
    second = F.xxhash64(*keys, F.lit("bits"))
    at = [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(64 * WORDS - 1)) for i in range(PROBES)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int")) for a in at]
    word = [F.shiftright(a, 6) for a in at]
    none = F.lit(0).cast("long")
    return [reduce(lambda x, y: x.bitwiseOR(y), [F.when(w == i, b).otherwise(none) for w, b in zip(word, bit)]) for i in range(WORDS)]


def bloom_table(keys: DataFrame, columns: list[str], count: int, most_blocks: int | None = None) -> tuple[DataFrame, int]:
    """The filter of the keys as ``block, w0 .. w7``, and its number of blocks; with fewer blocks than keys need it passes more."""
    blocks = max(1, min(-(-count * BITS_PER_KEY // (64 * WORDS)), most_blocks or 1 << 62))
    key = [F.col(c) for c in columns]
    rows = keys.select(_block(key, blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def bloom_hits(rows: DataFrame, columns: list[str], bloom: DataFrame, blocks: int, out: str) -> DataFrame:
    """``rows`` with a boolean column ``out``: may the key be one of the filter's? Null keys are not."""
    block, words = unused(rows, "__block"), [unused(rows, f"__w{i}") for i in range(WORDS)]
    key = [F.col(f"`{c}`") for c in columns]
    known = reduce(lambda x, y: x & y, [k.isNotNull() for k in key])
    table = bloom.select(F.col("block").alias(block), *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)])
    # rows without a key are dealt out, so that they don't meet in one task
    dealt = [F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind]
    placed = rows.withColumn(block, F.when(known, _block(key, blocks)).otherwise(F.pmod(F.xxhash64(*dealt), F.lit(blocks))))
    found = placed.join(F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table, block, "left")
    hit = reduce(lambda x, y: x & y, [F.col(w).bitwiseAND(m) == m for w, m in zip(words, _masks(key))])
    return found.withColumn(out, F.coalesce(hit, F.lit(False)) & known).select(*[F.col(f"`{c}`") for c in rows.columns], out)
