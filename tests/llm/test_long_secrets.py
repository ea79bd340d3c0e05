"""Weak secrets of any length are linked."""

import random
import string

import pytest

from wayframe.llm import secret_scan


@pytest.mark.parametrize("length", [20, 128, 129, 164, 5000])
def test_long_tokens_are_linked(length):
    rng = random.Random(length)
    token = "aB3" + "".join(rng.choices(string.ascii_letters + string.digits, k=length - 3))
    spans = secret_scan.secret_spans(f"login user@mail.example.com with {token} here")[1]
    assert [k for _, _, k in spans] == ["identifier", "secret"] and spans[1][1] - spans[1][0] == length
