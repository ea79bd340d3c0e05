"""Native operators and sharding against brute force, with awkward tables."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wayframe.llm import common, exact_dedup, sharding, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, shard string, __x int"
LONG = "long word " * 20_000


def rows(*texts, start=0):
    return [(start + k, t, "en", None, None, 1, "s", 0) for k, t in enumerate(texts)]


AWKWARD = rows("a", "a", None, "", LONG, LONG + "!", "b", "a", " a", "ä", "ä") + [(None, "a", None, None, None, None, None, None), (6, "b", None, None, None, None, None, None)]


def brute_dedup(data):
    groups = {}
    for r in data:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in data:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None) if len(ids) > 1 else r[0]
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("prune_rows", [0, 1000])
def test_exact_dedup(spark, prune_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PRUNE_ROWS", prune_rows)
    df = spark.createDataFrame(AWKWARD, DOCS)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=repr) == brute_dedup(AWKWARD)
    kept = exact_dedup.drop_copies(df, prune_rows=prune_rows)
    assert kept.columns == df.columns
    want = sorted(repr((d, k)) for d, k, _, is_kept, _ in brute_dedup(AWKWARD) if is_kept)
    assert sorted(repr((r.doc_id, r.doc_id)) for r in kept.collect()) == want


def test_dedup_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(df).count() == 0 and exact_dedup.drop_copies(df).count() == 0


def test_sharding_is_contiguous_and_balanced(spark):
    data = [(k * 3 % 997, "x" * (k * 37 % 400) if k % 11 else None, None, "hot", None, 1, None, None) for k in range(997)]
    out = sorted(map(tuple, sharding.shard_by_bytes(spark.createDataFrame(data, DOCS), 16, rows_per_part=100).collect()))
    assert [r[0] for r in out] == sorted(r[0] for r in data)
    assert [r[3] for r in out] == sorted(r[3] for r in out)
    sizes, slots = {}, {}
    texts = {r[0]: r[1] or "" for r in data}
    for doc, size, crc, shard, slot in out:
        assert size == len(texts[doc].encode()) + 1 and crc == zlib.crc32(texts[doc].encode())
        assert slot == slots.get(shard, 0)
        slots[shard], sizes[shard] = slot + 1, sizes.get(shard, 0) + size
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * 400


def test_sharding_edges(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0
    out = sharding.shard_by_bytes(spark.createDataFrame(AWKWARD, DOCS), 4).collect()
    assert len(out) == len(AWKWARD) and {r.doc_id for r in out} == {r[0] for r in AWKWARD}


URLS = [
    "http://a.example.net/en/1", "HTTP://WWW.Example.net/en/1?b=2&a=1&utm_source=x#top", "https://example.net/x", "http://x.example.com/de/", "http://example.org/fr/2", "nourl", None, "http://net/", "http://net", "://h/p?q",
    "http://mynet/x", "http://adult-x.example.org/p", "http://adult-x.example.org/p/?utm_medium=1", "http://example.com:80/", "http://U@h.de/ä?ref=1", "http://h\n/x",
]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    rule = None
    for h, p, v in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (rule is None or len(h + p) > len(rule[0])):
            rule = (h + p, v)
    return host, path, rule


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(URLS)], "page_id long, url string, host string, __block int")
    listed = spark.createDataFrame([("adult-x.example.org/p",), ("adult-x.example.org/p",), (None,), ("h.de/other",)], "key string")
    for r in urlfilter.judge(pages, listed).collect():
        host, path, rule = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        hit = r.page_id in (11, 12)
        assert r.listed == hit and r.verdict == (rule[1] if rule else "block" if hit else "allow")
    empty = spark.createDataFrame([], "key string")
    assert urlfilter.judge(pages, empty).where("listed").count() == 0
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert urlfilter.judge(pages, pages.select(urlfilter.canonical(F.col("url")).alias("key"))).where("NOT listed").count() == sum(u is None or "://" not in u for u in URLS)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host/"), "id").alias("url"))
    probes = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host/"), "id").alias("url"))
    assert urlfilter.listed_urls(probes, keys.withColumnRenamed("url", "key")).where("__listed").count() == 5000
    bloom, blocks = common.bloom_table(keys, ["url"], 5000)
    assert bloom.count() <= blocks


RECORDS = "record_id long, record_type string, url string, captured_at long, headers map<string,string>, digest string"


def brute_revisits(data):
    out = {}
    for rid, kind, url, at, headers, digest in data:
        if kind == "response":
            out[rid] = ("full", None, headers)
            continue
        prior = [r for r in data if r[1] == "response" and url and r[2] and r[2].rstrip("/") == url.rstrip("/") and at is not None and r[3] is not None and r[3] < at]
        if not prior:
            out[rid] = ("no_prior", None, headers)
            continue
        p = max(prior, key=lambda r: (r[3], r[0]))
        tag = headers.get("etag")
        strip = lambda t: t[2:] if t and t.startswith("W/") else t
        fine = strip(tag) == strip(p[4].get("etag")) if tag is not None else headers.get("last-modified") is not None and headers["last-modified"] == p[4].get("last-modified")
        merged = p[4] | {k: v for k, v in headers.items() if k in warc.PERMITTED}
        out[rid] = ("resolved", p[0], merged) if fine else ("validator_mismatch", None, headers)
    return out


def test_revisits(spark):
    data, n = [], 0
    for k in range(300):
        url = ["http://a.de/x", "http://a.de/x/", "http://b.de/y", None, "bad"][k % 5]
        at = None if k % 41 == 0 else (k * 7919) % 400_000
        headers = {"etag": ['"1"', 'W/"1"', '"2"'][k % 3], "last-modified": str(k % 2), "server": "s", "date": str(k)}
        if k % 4 == 0:
            headers.pop("etag")
        data.append((n, "response" if k % 3 == 0 else "revisit", url, at, headers, f"d{k}"))
        n += 1
    want = brute_revisits([r if r[2] != "bad" else (*r[:2], None, *r[3:]) for r in data])
    got = warc.resolve_revisits(spark.createDataFrame(data, RECORDS), slice_s=10_000).collect()
    assert len(got) == len(data) and {r.resolution for r in got} == {"full", "resolved", "no_prior", "validator_mismatch"}
    for r in got:
        assert (r.resolution, r.refers_to, r.headers) == want[r.record_id]
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nServer: s\r\n\r\nbody\r\n\r\nmore"
    one = warc.write_record("response", "http://a.de/x", "2024-01-01T00:00:00Z", http, "<urn:1>")
    two = warc.write_record("revisit", "http://a.de/x", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n", "<urn:2>", WARC_Profile="server-not-modified")
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(warc.write_record("warcinfo", "", "2024-01-01T00:00:00Z", b"x", "<urn:0>")) + gzip.compress(one) + gzip.compress(two))
    records = warc.read_warc(spark, str(tmp_path))
    rows_ = records.orderBy("record_id").collect()
    assert [r.status for r in rows_] == [200, 304] and bytes(rows_[0].payload) == b"body\r\n\r\nmore"
    assert [r.digest is not None for r in rows_] == [True, False] and all(r.whole for r in rows_)
    out = warc.resolve_revisits(records).where("record_type = 'revisit'").first()
    assert out.resolution == "resolved" and out.refers_to == "<urn:1>" and out.headers["server"] == "s"


def test_warc_records_are_cut_and_put_together(spark, tmp_path):
    inner = warc.write_record("response", "http://a.de/in", "2024-01-01T00:00:00Z", b"x\r\n\r\n", "<urn:in>")
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + b for b in (inner + inner, b"", bytes(range(256)) * 20, b"\r\n\r\nWARC/", b"long " * 300_000)]
    data = b"".join(warc.write_record("response", f"http://a.de/{k}", "2024-01-01T00:00:00Z", b, f"<urn:{k}>") for k, b in enumerate(bodies))
    assert [r["body"] for r in warc.parse_warc(data)] == bodies and warc.parse_warc(b"") == []
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.write_record("response", f"http://b.de/{k}", "bad date", b, f"<urn:b{k}>")) for k, b in enumerate(bodies)))
    rows_ = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows_) == 10 and all(r.whole for r in rows_)
    assert sorted(bytes(r.payload) for r in rows_) == sorted(b.partition(b"\r\n\r\n")[2] for b in bodies * 2)


def test_only_full_responses_and_not_modified_revisits_resolve(spark):
    data = [
        (1, "response", "http://a.de/", 10, 200, {"etag": "x"}, "d", None, 7), (2, "response", "http://a.de/", 20, 404, {"etag": "x"}, "e", None, 7), (3, "response", "http://a.de/", 20, None, {"etag": "x"}, "e", None, 7),
        (4, "revisit", "http://a.de/", 30, 304, {"etag": "x"}, None, "http://x/revisit/Server-Not-Modified", 7), (4, "revisit", "http://a.de/", 30, 304, {"etag": "x"}, None, None, 7),
        (5, "revisit", "http://a.de/", 30, 304, {"etag": "x"}, None, "http://x/revisit/identical-payload-digest", 7), (6, "revisit", "http://a.de/", 30, 200, {"etag": "x"}, None, None, 7),
        (7, "revisit", "http://a.de/", 5, None, {"etag": "x"}, None, None, 7), (8, "request", "http://a.de/", 40, None, {}, None, None, 7), (9, "revisit", "http://a.de/" + "p" * 100_000, 50, 304, {}, None, None, 7),
    ]
    df = spark.createDataFrame(data, "record_id long, record_type string, url string, captured_at long, status int, headers map<string,string>, digest string, profile string, __prior int")
    got = sorted((r.record_id, r.resolution, r.refers_to) for r in warc.resolve_revisits(df).collect())
    assert got == [(1, "full", None), (2, "not_full", None), (3, "not_full", None), (4, "resolved", 1), (4, "resolved", 1), (5, "other_profile", None), (6, "other_profile", None), (7, "no_prior", None), (8, "other_type", None), (9, "no_prior", None)]


def test_filter_paths_that_shuffle(spark, monkeypatch):
    listed = spark.createDataFrame([("adult-x.example.org/p",), (None,), ("h.de/other",)], "key string")
    pages = spark.createDataFrame([(k, u, "x", 1, 2) for k, u in enumerate([*URLS, "http://h.de/" + "x" * 200_000])], "page_id long, url string, w0 string, __block int, __canon int")
    want = sorted(map(tuple, urlfilter.judge(pages, listed).collect()))
    assert urlfilter.listed_urls(pages, listed).columns[:5] == pages.columns
    monkeypatch.setattr(urlfilter, "BROADCAST_LIST", -1)
    monkeypatch.setattr(common, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, urlfilter.judge(pages, listed).collect())) == want


def test_dedup_hashes_survivors_only(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bb"), (4, "ccc"), (5, None)], "doc_id long, text string")
    for bound in (0, 100):
        alive, count = exact_dedup._survivors(docs, "text", 128, bound)
        hashed, passed, sha = exact_dedup._parts(docs, "text", 128, bound, alive, count)
        assert count == 1 and sorted(r.doc_id for r in hashed.where(F.col(sha).isNotNull()).collect()) == [1, 2]
        assert (passed is None) == (bound == 100) and (passed is None or {r.doc_id for r in passed.collect()} >= {4, 5})
