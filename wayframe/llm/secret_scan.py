"""Secret scan with multipart credential linking.

Base patterns report by themselves: assignments, cloud access identifiers and long
hexadecimal strings. Weak candidates are parts of a credential that mean little alone:
identifiers (mail addresses, named account or client ids), secrets (mixed strings of
high entropy) and endpoints (web addresses, hosts with a port). Parts are intervals;
within a scope, a paragraph and ``WINDOW`` characters to either side, they are joined by
binary search over sorted, non-overlapping intervals, and a weak candidate is reported
only when complementary parts co-occur: a secret needs an identifier or an endpoint, an
identifier or an endpoint needs a secret. Base spans count as parts (an access identifier
as an identifier, the others as secrets) and are never removed.

Texts are scanned whole, in one pass without a shuffle; the work is linear in the text but
for sorting its parts: addresses and hosts are sought from their signs outwards, so no run
of letters is read more than a few times.

Defined cases: null text is empty and has no spans; very long texts and tokens are scanned
whole, in one row; equal starts go by kind as listed in ``KINDS``; a weak secret that
overlaps a base span, an identifier or an endpoint is theirs; repeated rows are scanned
alike; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MIN_ENTROPY = 200, 3.0
# fixed values: kinds in the order of their listing, and the base patterns
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # shorter runs hold no longer match
HEX = re.compile(r"[0-9a-f]{32,}")  # likewise
# weak parts
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NAMED_ID = re.compile(r"\b(?:access_key_id|client_id|account_id|key_id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
ADDRESS = re.compile(r"https?://[^\s\"'<>]+")
PORT = re.compile(r":[0-9]{2,5}\b")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
HOST = LABEL | {"."}
HOST_NAME = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()  # only to see whether a scan is needed
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span):
    return span[0], KINDS.index(span[2]), span[1]


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and _entropy(value) >= MIN_ENTROPY


class _Intervals:
    """Intervals merged where they overlap, so that starts and ends are both sorted."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, lo: int, hi: int) -> bool:
        """Is there one with a character in [lo, hi)?"""
        k = bisect_left(self.ends, lo + 1)
        return k < len(self.starts) and self.starts[k] < hi


def _back(text: str, end: int, least: int, allowed: frozenset[str]) -> int:
    """Where the run of allowed characters before ``end`` begins, not before ``least``."""
    start = end
    while start > least and text[start - 1] in allowed:
        start -= 1
    return start


def mails(text: str) -> list[tuple[int, int]]:
    """Mail addresses, leftmost first and not overlapping: the characters around each ``@``."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = _back(text, at, last, LOCAL)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """Web addresses, and dotted host names with a port outside of them."""
    out = [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
    inside, last = _Intervals(out), 0
    for m in PORT.finditer(text):
        start = _back(text, m.start(), last, HOST)
        if start and text[start - 1] in LABEL:  # the rest of a label that an earlier host took begins no host
            start = text.find(".", start, m.start())
            if start < 0:
                continue
        start = max(start, text.rfind("..", start, m.start()) + 2) if ".." in text[start : m.start()] else start
        while start < m.start() and text[start] == ".":
            start += 1
        if HOST_NAME.fullmatch(text, start, m.start()):
            last = m.end()
            if not inside.meets(start, m.end()):
                out.append((start, m.end()))
    return sorted(out)


def linked_spans(text: str, base: list[Span], window: int = WINDOW) -> list[Span]:
    """Weak candidates whose complementary parts co-occur in their scope."""
    taken = _Intervals([(s, e) for s, e, _ in base])
    weak = [(m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if _mixed(m.group()) and not taken.meets(m.start(), m.end())]
    if not weak and not base:
        return []  # identifiers and endpoints need a secret
    named = [(m.start(), m.end()) for m in NAMED_ID.finditer(text)] if ":" in text or "=" in text else []
    weak_ids, points = _Intervals(mails(text) + named), _Intervals(endpoints(text) if ":" in text else [])
    weak = [(s, e) for s, e in weak if not weak_ids.meets(s, e) and not points.meets(s, e)]
    secrets = _Intervals(weak + [(s, e) for s, e, k in base if k != "access"])
    ids = _Intervals(list(zip(weak_ids.starts, weak_ids.ends)) + [(s, e) for s, e, k in base if k == "access"])

    def scope(s: int, e: int) -> tuple[int, int]:
        before, after = text.rfind("\n\n", max(0, s - window), s), text.find("\n\n", e, e + window)
        return (before + 2 if before >= 0 else s - window), (after if after >= 0 else e + window)

    out: list[Span] = [(s, e, "secret") for s, e in weak if ids.meets(*scope(s, e)) or points.meets(*scope(s, e))]
    out += [(s, e, "identifier") for s, e in zip(weak_ids.starts, weak_ids.ends) if secrets.meets(*scope(s, e))]
    out += [(s, e, "endpoint") for s, e in zip(points.starts, points.ends) if secrets.meets(*scope(s, e))]
    return out


def secret_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both in order."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for every row."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, spans, linked = [], [], []
            for text in batch.column(1):
                base, every = secret_spans(text.as_py())
                for k in counts:
                    counts[k].append(sum(x[2] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                linked.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts.values()], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(linked, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
