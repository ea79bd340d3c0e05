"""WARC records and resolution of not-modified revisits.

``read_warc`` reads records as Spark's text reader streams them, cut where a record
begins, so neither an archive nor its decompressed copy is held in memory;
``resolve_revisits`` finds, for each revisit of the server-not-modified kind, the latest
earlier full response of the same canonical URL, checks the validators and merges the
permitted headers. A full response is one with status 200.

The as-of join takes three levels, so that one URL with a third of all records is never
gathered in one task: all records of one URL and second are a partial aggregate; the
seconds of one time slice are put in order, at most ``slice_s`` of them; the latest
response of every slice is carried forward over a URL's slices.

Defined cases: revisits without a canonical URL or time stay unresolved
(``no_prior``); of responses at one time the larger record id counts as later;
a response at the time of a revisit is not earlier; an entity tag, where a revisit
sends one, decides alone, else its date does; a revisit without either, or whose
deciding one differs from the response's, is ``validator_mismatch``; a revisit of
another profile is ``other_profile``, a response of another status ``not_full``, and a
record of any other type ``other_type``; a missing column ``status`` counts as 200, a
missing or null ``profile`` as not-modified unless the status is known and not 304;
repeated records are each resolved; URLs and headers of any length are read whole;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .urlfilter import URLS_SQL, canonical

# fixed values: header fields that a 304 answer may update
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Seconds in one time slice.
SLICE_S = 86_400


#: What stands before a record's version number, and from a record to the next.
MARK, BREAK = b"WARC/", b"\r\n\r\nWARC/"
VERSION = re.compile(rb"\d+\.\d+\r?\n")


def records_of(pieces):
    """The records of an archive's pieces, cut at ``BREAK``: ``headers`` (names in lower case), ``body`` and whether it is ``whole``.

    A body that holds the mark itself is put together again by its length.
    """
    held: list[bytes] | None = None  # the pieces of a record not yet whole
    headers: dict[str, str] = {}
    size = need = 0

    def done():
        body = BREAK.join(held)
        return {"headers": headers, "body": body[:need], "whole": len(body) >= need}

    for piece in pieces:
        if held is not None and size < need:
            held.append(piece)
            size += len(BREAK) + len(piece)
            continue
        if held is not None:
            yield done()
            held = None
        piece = piece.removeprefix(MARK)
        if not VERSION.match(piece):
            continue  # the rest of a record that began before
        end = re.search(rb"\r?\n\r?\n", piece)
        head, body = (piece[: end.start()], piece[end.end() :]) if end else (piece, b"")
        fields = (line.decode("utf-8", "replace").partition(":") for line in head.splitlines()[1:])
        headers = {n.strip().lower(): v.strip() for n, s, v in fields if s}
        length = headers.get("content-length", "")
        held, size, need = [body], len(body), int(length) if length.isdigit() else 0
    if held is not None:
        yield done()


def parse_warc(data: bytes) -> list[dict]:
    """The records of plain WARC bytes."""
    return list(records_of(data.split(BREAK)))


def parse_http(body: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (names in lower case) and payload of an HTTP answer."""
    head, _, payload = body.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    parts = first.split(" ")
    headers = {n.strip().lower(): v.strip() for n, s, v in (x.partition(":") for x in lines) if s}
    return (int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None), headers, payload


def write_record(kind: str, url: str, date: str, body: bytes, record_id: str, **more: str) -> bytes:
    """One WARC/1.1 record as bytes."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": url, "WARC-Date": date}
    fields |= {k.replace("_", "-"): v for k, v in more.items()} | {"Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


RECORDS = "record_id string, record_type string, url string, captured_at long, status int, headers map<string,string>, payload binary, digest string, profile string, whole boolean"


def _row(record: dict) -> tuple:
    h = record["headers"]
    status, fields, payload = parse_http(record["body"])
    try:
        at = int(datetime.fromisoformat(h.get("warc-date", "").replace("Z", "+00:00")).timestamp())
    except ValueError:
        at = None
    digest = h.get("warc-payload-digest")
    if digest is None and h["warc-type"] == "response":
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri", "").strip("<>"), at, status, list(fields.items()), payload, digest, h.get("warc-profile"), record["whole"]


def read_warc(spark, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, plain or ``.gz``: one row per response or revisit.

    Plain files are split between tasks. A record whose body holds ``BREAK`` and lies across
    such a split is cut there and marked as not ``whole``; without a digest of its own, a
    response gets the SHA-1 of its payload.
    """
    text = pa.string()
    types = [text, text, text, pa.int64(), pa.int32(), pa.map_(text, text), pa.binary(), text, text, pa.bool_()]
    names = [part.split(" ")[0] for part in RECORDS.split(", ")]

    def rows(batches):
        # a task reads its files one after another; a file's name ends the records of the one before
        files = ((f, piece) for batch in batches for f, piece in zip(batch.column(0).to_pylist(), batch.column(1)))
        out, size = [], 0
        from itertools import groupby

        for _, pieces in groupby(files, key=lambda x: x[0]):
            for record in records_of(piece.as_py() for _, piece in pieces):
                if record["headers"].get("warc-type") not in ("response", "revisit"):
                    continue
                out.append(_row(record))
                size += len(record["body"])
                if size > 16 << 20 or len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    lines = spark.read.option("lineSep", BREAK.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(rows, RECORDS)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """One row per record.

    ``records``: ``record_id, record_type`` (response or revisit), ``url, captured_at``
    (seconds), ``headers`` (map), ``digest`` of the payload and, if there, ``status`` and
    ``profile``. Returns ``record_id, record_type, canonical_url, captured_at, resolution``
    (full, not_full, resolved, validator_mismatch, no_prior, other_profile, other_type),
    ``refers_to``, ``digest`` and merged ``headers``.
    """
    status = F.col("status").cast("int") if "status" in records.columns else F.lit(None).cast("int")
    profile = F.col("profile") if "profile" in records.columns else F.lit(None).cast("string")
    fine = F.coalesce(status == 200, F.lit("status" not in records.columns))
    unmodified = F.coalesce(F.lower(profile).endswith("server-not-modified"), F.coalesce(status == 304, F.lit(True)))
    kind = (
        F.when(F.col("record_type") == "response", F.when(fine, "full").otherwise("not_full"))
        .when(F.col("record_type") == "revisit", F.when(unmodified, "asks").otherwise("other_profile"))
        .otherwise("other_type")
    )
    rows = records.select(
        "record_id", "record_type", canonical(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"), "headers", "digest", kind.alias("__kind")
    )
    is_full, asks = F.col("__kind") == "full", F.col("__kind") == "asks"
    dated = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    stored = F.struct("captured_at", "record_id", "headers", "digest")
    # all records of a URL at one second
    sliced = rows.withColumn("__slice", F.floor(F.col("captured_at") / F.lit(slice_s)).cast("long"))
    points = sliced.where(dated & (is_full | asks)).groupBy("canonical_url", "__slice", "captured_at").agg(
        F.max_by(F.when(is_full, stored), F.when(is_full, F.struct("record_id"))).alias("__here"), F.max(asks).alias("__asked")
    )
    # the latest response before each second of a slice, and before each slice
    within = Window.partitionBy("canonical_url", "__slice").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("__inside", F.last("__here", ignorenulls=True).over(within))
    slices = points.groupBy("canonical_url", "__slice").agg(F.max_by("__here", F.when(F.col("__here").isNotNull(), F.col("captured_at"))).alias("__last"))
    over = Window.partitionBy("canonical_url").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("canonical_url", "__slice", F.last("__last", ignorenulls=True).over(over).alias("__before"))
    priors = points.where("__asked").join(carried, ["canonical_url", "__slice"]).select("canonical_url", "captured_at", F.coalesce("__inside", "__before").alias("__prior"))
    found = rows.where(dated & asks).join(priors, ["canonical_url", "captured_at"], "left")
    others = rows.where(~(dated & asks)).withColumn("__prior", F.lit(None).cast(found.schema["__prior"].dataType))
    rows = found.unionByName(others)
    old, new = F.col("__prior.headers"), F.col("headers")
    etag, since = new["etag"], new["last-modified"]
    agrees = F.when(etag.isNotNull(), _opaque(etag).eqNullSafe(_opaque(old["etag"]))).otherwise(since.isNotNull() & since.eqNullSafe(old["last-modified"]))
    resolution = F.when(~asks, F.col("__kind")).when(F.col("__prior").isNull(), "no_prior").when(agrees, "resolved").otherwise("validator_mismatch")
    rows = rows.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    allowed = F.array(*map(F.lit, PERMITTED))
    fresh = F.map_filter(new, lambda k, v: F.array_contains(allowed, k))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return rows.select(
        "record_id", "record_type", "canonical_url", "captured_at", "resolution",
        F.when(done, F.col("__prior.record_id")).alias("refers_to"),
        F.when(done, F.col("__prior.digest")).when(~asks, F.col("digest")).alias("digest"),
        F.when(done, merged).otherwise(new).alias("headers"),
    )


def headers_text(headers: Column) -> Column:
    """Headers as sorted ``name: value`` lines."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")


#: The query's captures of a page: seconds from one page to the next, and a day.
START, MINUTE, DAY = 1_700_000_000, 60, 86_400


def page_records(pages: DataFrame) -> DataFrame:
    """Five records per page, over four days: a revisit before any response, a response, a revisit, a changed response, a revisit.

    Every tenth page stands for its host's front page, which many pages then share. Every
    fourth page's second response is an error; every fifth's middle revisit sends another
    entity tag, every seventh's only its date; every third's last revisit still has the
    first tag, and every sixth's is of the other profile.
    """
    n = F.col("page_id")
    front = F.pmod(n, F.lit(10)) == 9
    host = F.regexp_extract("url", "^[^:/?#]*://[^/?#]*", 0)
    page = pages.select(n, F.when(front, F.concat(host, F.lit("/"))).otherwise(F.col("url")).alias("url"), F.coalesce(F.when(front, host).otherwise(F.col("html")), F.lit("")).alias("__html"))
    one, two = (F.md5(F.concat("__html", F.lit(end)).cast("binary")) for end in ("", "#2"))
    at = F.lit(START) + n * MINUTE
    tag = lambda digest: F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), F.coalesce(F.floor(n / 100).cast("string"), F.lit("")))

    def record(place, kind, time, status, etag, modified, digest, profile):
        sent = [F.lit("date"), F.coalesce(time.cast("string"), F.lit("")), F.lit("last-modified"), modified, F.lit("content-type" if kind == "response" else "server"), F.lit("text/html" if kind == "response" else "edge")]
        headers = F.map_filter(F.create_map(*sent, F.lit("etag"), etag), lambda k, v: v.isNotNull())
        return F.struct(
            (n * 5 + place).alias("record_id"), F.lit(kind).alias("record_type"), "url", time.alias("captured_at"), status.cast("int").alias("status"), headers.alias("headers"),
            digest.cast("string").alias("digest"), profile.cast("string").alias("profile"),
        )

    none, same = F.lit(None), F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    middle = F.when(F.pmod(n, F.lit(7)) == 0, none).when(F.pmod(n, F.lit(5)) == 0, '"changed"').otherwise(tag(one))
    last = F.when(F.pmod(n, F.lit(3)) == 0, tag(one)).otherwise(tag(two))
    other = F.when(F.pmod(n, F.lit(6)) == 0, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest").otherwise(same)
    later = F.concat(day, F.lit(" later"))
    made = [
        record(0, "response", at + DAY, F.lit(200), tag(one), day, one, none),
        record(1, "response", at + 3 * DAY, F.when(F.pmod(n, F.lit(4)) == 0, 503).otherwise(200), tag(two), later, two, none),
        record(2, "revisit", at, F.lit(304), tag(one), day, none, same),
        record(3, "revisit", at + 2 * DAY, F.lit(304), middle, day, none, same),
        record(4, "revisit", at + 4 * DAY, F.lit(304), last, later, none, other),
    ]
    return page.select(F.explode(F.array(*made)).alias("r")).select("r.*")


SQL = f"""
WITH captured AS (
  SELECT page_id, CASE WHEN page_id % 10 = 9 THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || '/' ELSE url END AS url,
         coalesce(CASE WHEN page_id % 10 = 9 THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') ELSE html END, '') AS html
  FROM pages),
{URLS_SQL.replace("FROM pages", "FROM captured")},
u AS (SELECT page_id AS p, canonical_url, {START} + page_id * {MINUTE} AS t, md5(html) AS d1, md5(html || '#2') AS d2,
             '"' || substr(md5(html), 1, 12) || '"' AS e1, '"' || substr(md5(html || '#2'), 1, 12) || '"' AS e2, 'day ' || CAST(page_id // 100 AS VARCHAR) AS lm
      FROM urls),
r AS (
  SELECT p * 5 AS record_id, 'response' AS record_type, canonical_url, t + {DAY} AS captured_at, 'full' AS kind, e1 AS etag, lm, d1 AS digest FROM u
  UNION ALL SELECT p * 5 + 1, 'response', canonical_url, t + 3 * {DAY}, CASE WHEN p % 4 = 0 THEN 'not_full' ELSE 'full' END, e2, lm || ' later', d2 FROM u
  UNION ALL SELECT p * 5 + 2, 'revisit', canonical_url, t, 'asks', e1, lm, NULL FROM u
  UNION ALL SELECT p * 5 + 3, 'revisit', canonical_url, t + 2 * {DAY}, 'asks', CASE WHEN p % 7 = 0 THEN NULL WHEN p % 5 = 0 THEN '"changed"' ELSE e1 END, lm, NULL FROM u
  UNION ALL SELECT p * 5 + 4, 'revisit', canonical_url, t + 4 * {DAY}, CASE WHEN p % 6 = 0 THEN 'other_profile' ELSE 'asks' END, CASE WHEN p % 3 = 0 THEN e1 ELSE e2 END, lm || ' later', NULL FROM u),
stored AS (SELECT * FROM r WHERE kind = 'full' QUALIFY row_number() OVER (PARTITION BY canonical_url, captured_at ORDER BY record_id DESC) = 1),
prior AS (
  SELECT r.*, f.record_id AS f_id, f.digest AS f_digest, f.etag AS f_etag, f.lm AS f_lm
  FROM r ASOF LEFT JOIN stored f ON r.canonical_url = f.canonical_url AND r.captured_at > f.captured_at),
judged AS (
  SELECT *, CASE WHEN kind <> 'asks' THEN kind WHEN f_id IS NULL THEN 'no_prior'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN lm = f_lm THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM prior)
SELECT record_id, record_type, canonical_url, captured_at, resolution,
       CASE WHEN resolution = 'resolved' THEN f_id END AS refers_to,
       CASE WHEN resolution = 'resolved' THEN f_digest WHEN kind <> 'asks' THEN digest END AS digest,
       CASE WHEN resolution = 'resolved' OR record_type = 'response' THEN 'content-type: text/html' || chr(10) ELSE '' END
         || 'date: ' || CAST(captured_at AS VARCHAR)
         || coalesce(chr(10) || 'etag: ' || CASE WHEN resolution = 'resolved' THEN coalesce(etag, f_etag) ELSE etag END, '')
         || chr(10) || 'last-modified: ' || lm
         || CASE WHEN resolution <> 'resolved' AND record_type = 'revisit' THEN chr(10) || 'server: edge' ELSE '' END AS headers
FROM judged
"""
