"""URL filtering: host/path rules, then a block list behind a blocked Bloom filter.

The listed canonical URLs set bits in a blocked Bloom filter: a table with one row
of eight 64-bit words per block, built with ``bit_or``. Every URL looks at exactly
one block; possible hits go to an exact hash join that removes false positives,
all other URLs skip it. Only DataFrame functions are used.

The filter is broadcast when its size, known from the number of listed URLs, is
bounded; a larger one is joined by block number. Likewise the list itself, for the
exact join; a larger one is joined by its text, which leaves skew to Spark's runtime
splitting.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule
and no canonical form, and is allowed; very long URLs are judged whole; repeated pages
are judged alike; an empty list blocks nothing, an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_hits, bloom_table, checkpointed, unused

# fixed values: the rules (host, path, verdict)
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Query parameters that only track a visit.
TRACKING = "utm_[^=]*|ref|gclid|fbclid"
#: Bytes of listed URLs that the exact join may broadcast.
BROADCAST_LIST = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slash, sorted query without tracking; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", key_col: str = "key", canon: str = "__canon", out: str = "__listed") -> DataFrame:
    """``urls`` with the columns ``canon`` and ``out``; ``listed`` has canonical URLs in ``key_col``.

    A list whose exact keys may be broadcast is joined in the pass that probes; for a larger
    one, what the filter passes is shuffled to its keys and all other rows are not.
    """
    canon, out = unused(urls, canon), unused(urls, out)
    maybe, there, probe = unused(urls, "__maybe"), unused(urls, "__in"), unused(urls, "__probe")
    wanted = checkpointed(listed.select(F.col(f"`{key_col}`").alias(probe)).where(F.col(probe).isNotNull()).distinct())
    count, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(probe) + 40), F.lit(0))).first()
    bloom, blocks = bloom_table(wanted, [probe], count)
    rows = bloom_hits(urls.withColumn(canon, canonical(F.col(f"`{url_col}`"))), [canon], bloom, blocks, maybe)
    exact, keep = wanted.withColumn(there, F.lit(True)), [F.col(f"`{c}`") for c in [*urls.columns, canon]]
    if size <= BROADCAST_LIST:
        found = rows.withColumn(probe, F.when(F.col(maybe), F.col(canon))).join(F.broadcast(exact), probe, "left")
        return found.select(*keep, F.coalesce(there, F.lit(False)).alias(out))
    passed = rows.where(~F.col(maybe)).select(*keep, F.lit(False).alias(out))
    found = rows.where(maybe).withColumn(probe, F.col(canon)).join(exact, probe, "left")
    return passed.unionByName(found.select(*keep, F.coalesce(there, F.lit(False)).alias(out)))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", key_col: str = "key", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical_url, listed`` for every row."""
    rows = listed_urls(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), listed, "url", key_col)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("__canon").alias("canonical_url"), F.col("__listed").alias("listed"))


#: Host labels whose pages make up the query's list.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def list_from(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """A stand-in for a published list, as ``key``: canonical URLs of pages on hosts with one of the
    labels, and for each of them a URL below it, most of which no page has."""
    host, key = host_of(F.col("url")), canonical(F.col("url"))
    found = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels))))
    return found.select(F.explode(F.array(key, F.concat(key, F.lit("/archive")))).alias("key"))


CANON_SQL = """
CASE WHEN contains(url, '://') THEN
  regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN tail <> '' THEN '?' || tail ELSE '' END END"""

URLS_SQL = f"""
urls AS (
  SELECT *, {CANON_SQL} AS canonical_url FROM (
    SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)'))), '&'), '') AS tail
    FROM (SELECT page_id, url, html,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
            coalesce(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '') AS query
          FROM pages)))
"""

SQL = f"""
WITH {URLS_SQL},
labelled AS (SELECT canonical_url FROM urls
             WHERE list_has_any(string_split(host, '.'), [{', '.join(f"'{x}'" for x in LISTED_LABELS)}]) AND canonical_url IS NOT NULL),
listed AS (SELECT canonical_url FROM labelled UNION SELECT canonical_url || '/archive' FROM labelled),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM urls)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       r.canonical_url AS canonical_url, l.canonical_url IS NOT NULL AS listed
FROM ruled r LEFT JOIN listed l ON r.canonical_url = l.canonical_url
"""
