"""Sinks: day-partitioned positions with retention, reports, documents, archives."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_by_day(df: DataFrame, path: str, time: str = "observed_at", day: str = "observed_day") -> None:
    """Appends rows under one folder per UTC day; day filters then prune folders."""
    df.withColumn(day, F.to_date(time)).write.mode("append").partitionBy(day).parquet(path)


def retention_cutoff(today: datetime.date, days: int) -> datetime.date:
    """The first day that is kept."""
    return today + datetime.timedelta(days=1 - days)


def retained(df: DataFrame, today: datetime.date, days: int, day: str = "observed_day") -> DataFrame:
    return df.where(F.col(day) >= F.lit(retention_cutoff(today, days)))


def drop_expired_days(spark: SparkSession, path: str, today: datetime.date, days: int, day: str = "observed_day") -> list[str]:
    """Deletes the folders of expired days on the table's own file system; returns their days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff, gone = retention_cutoff(today, days), []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith(f"{day}=") and name[len(day) + 1 :] < cutoff.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name[len(day) + 1 :])
    return sorted(gone)


def overwrite(df: DataFrame, path: str) -> None:
    """Truncate-and-recompute of a table."""
    df.write.mode("overwrite").parquet(path)


def bulk_load(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Stages tables as they are, replacing what the folder held, and reads them back."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        overwrite(df, f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def report_lines(header: DataFrame, analyses: DataFrame, order: list[str]) -> DataFrame:
    """A report's lines as ``seq, kind, line``: one header, the analyses in order, and a last line that counts them.

    A reader that finds no last line, or another count than lines, has a cut report.
    """
    over = Window.orderBy(*order)  # a report is read by people: its rows are few
    first = header.limit(1).select(F.lit(0).cast("long").alias("seq"), F.lit("header").alias("kind"), F.to_json(F.struct(*header.columns)).alias("line"))
    rows = analyses.select(F.row_number().over(over).cast("long").alias("seq"), F.lit("analysis").alias("kind"), F.to_json(F.struct(*analyses.columns)).alias("line"))
    last = analyses.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + 1).alias("seq"), F.lit("complete").alias("kind"), F.to_json(F.struct(F.col("n").alias("analyses"))).alias("line"))
    return first.unionByName(rows).unionByName(last)


def write_archive(captures: DataFrame, folder: str, body: str = "body") -> None:
    """Distinct bodies, compressed, and one line of metadata for each capture that refers to them."""
    bodies, refers = archive_bodies(captures, body)
    bodies.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/bodies")
    refers.write.mode("overwrite").json(f"{folder}/captures")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON document per row; the completion marker tells a whole report."""
    df.write.mode("overwrite").json(path)


def archive_bodies(captures: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Distinct bodies by content hash, and captures that refer to them."""
    hashed = captures.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256))
    bodies = hashed.groupBy("sha256").agg(F.first(body).alias(body), F.count(F.lit(1)).alias("uses"))
    return bodies, hashed.drop(body)


def route_documents(route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """One JSON document per route; repeated stops get distinct ids ``id#seq``."""
    every = Window.partitionBy("route_id", "stop_id")
    rows = route_stops.join(stops, "stop_id").withColumn("__n", F.count(F.lit(1)).over(every))
    ident = F.when(F.col("__n") > 1, F.concat_ws("#", F.col("stop_id").cast("string"), F.col("stop_seq").cast("string"))).otherwise(F.col("stop_id").cast("string"))
    stop = F.struct("stop_seq", ident.alias("id"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"))
    listed = F.transform(F.array_sort(F.collect_list(stop)), lambda s: F.struct(s["id"].alias("id"), s["position"].alias("position")))
    return rows.groupBy("route_id").agg(F.to_json(F.struct(listed.alias("stops"))).alias("document"))


#: Features of one layer that a single document may hold.
MOST_FEATURES = 50_000


def map_snapshot(layers: dict[str, DataFrame], status: dict[str, object]) -> DataFrame:
    """One document of feature collections (``layer`` to ``geojson, properties`` rows) and a status part."""
    spark = next(iter(layers.values())).sparkSession
    parts = None
    for name, rows in layers.items():
        if (found := rows.limit(MOST_FEATURES + 1).count()) > MOST_FEATURES:
            raise ValueError(f"layer {name} has more than {MOST_FEATURES} features; found at least {found}")
        part = rows.agg(F.lit(name).alias("layer"), F.array_sort(F.collect_list(F.to_json(F.struct(F.lit("Feature").alias("type"), "geojson", "properties")))).alias("features"))
        parts = part if parts is None else parts.unionByName(part)
    fixed = spark.createDataFrame([(str(k), str(v)) for k, v in status.items()], "k string, v string")
    joined = fixed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("status"))
    return parts.agg(F.map_from_entries(F.collect_list(F.struct("layer", "features"))).alias("layers")).crossJoin(F.broadcast(joined)).select(F.to_json(F.struct("layers", "status")).alias("document"))


def schema_problems(df: DataFrame, schema: StructType) -> list[str]:
    """Columns that are missing or of another type; empty when the table is ready."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: missing" for f in schema if f.name not in have] + [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType
    ]
