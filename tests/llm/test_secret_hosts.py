"""A host with a port is found behind dots, behind a port that names no host, and behind a host that ends in its label."""

import pytest

from wayframe.llm import secret_scan


@pytest.mark.parametrize(
    "text, want",
    [
        ("x..db.example.com:5432", "db.example.com:5432"), ("a.b...c.d:80", "c.d:80"), ("x:8080.a.b:80", "8080.a.b:80"),
        ("a.b:80-c.d.e:90", "a.b:80 d.e:90"), ("a.b:80-c.d:90", "a.b:80"), ("a.b.:80", ""), ("a..b:80", ""), ("a.b:80.c.d:90", "a.b:80 c.d:90"),
    ],
)
def test_hosts(text, want):
    assert " ".join(text[s:e] for s, e in secret_scan.endpoints(text)) == want


def test_reported_case():
    text = "password0123456789abcdef..db.example.com:5432"
    assert [k for _, _, k in secret_scan.secret_spans(text)[1]] == ["secret", "endpoint"]
