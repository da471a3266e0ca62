"""Secrets inside longer tokens, and secrets without digits."""

import base64
import inspect
import random
import re
import string

import pytest

from tessera.llm import secrets

MIXED = string.ascii_letters + string.digits


@pytest.mark.parametrize(
    ("before", "after", "alphabet"),
    [("", "", string.ascii_letters), ("/home/user/config/", "", MIXED), ("example/services/session/token/", "", MIXED), ("client_secret_value=", "", MIXED), ("see /data/output/", "/session/index.html", MIXED)],
)
def test_embedded_secrets_are_found(spark, before, after, alphabet):
    model, rng = secrets.train(spark), random.Random(8)
    right = 0
    for _ in range(200):
        text = before + "".join(rng.choice(alphabet) for _ in range(24)) + after
        right += (len(before), 3, len(before) + 24) in secrets.markov_spans(text, model, secrets.base_spans(text))
    assert right > 180


def test_rest_of_a_token_beside_a_base_span(spark):
    model = secrets.train(spark)
    text = "0123456789abcdef0123/x9Kd72LmQ0zPw4Vt8RbY1"
    assert secrets.markov_spans(text, model, secrets.base_spans(text)) == [(21, 3, 42)]


def test_ordinary_tokens_have_no_secrets(spark):
    model = secrets.train(spark)
    held = [t for t, y in secrets.labelled_samples(1000, seed=99) if not y]
    assert sum(bool(secrets.markov_spans(t, model, secrets.base_spans(t))) for t in held) < 10


def test_strings_of_other_sources(spark):
    """Keys from random bytes against long identifiers and paths in the sources of the standard library."""
    import argparse
    import asyncio.base_events
    import email.message
    import http.client
    import logging.handlers
    import subprocess
    import unittest.mock

    model, rng = secrets.train(spark), random.Random(21)
    keys = [base64.b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (15, 18, 24, 33) for _ in range(100)]
    sources = " ".join(inspect.getsource(m) for m in (argparse, asyncio.base_events, email.message, http.client, logging.handlers, subprocess, unittest.mock))
    plain = sorted({t for t in re.findall(r"[A-Za-z0-9+/_=-]{16,}", sources) if re.search("[a-z]", t)})
    hit = lambda t: bool(secrets.markov_spans(t, model, secrets.base_spans(t)))
    found, wrong = sum(map(hit, keys)), sum(map(hit, plain))
    assert len(plain) > 400 and found / len(keys) > 0.9 and found / (found + wrong) > 0.9


def test_runs_of_few_characters_and_uuids(spark):
    model = secrets.train(spark)
    for text in ("aaaaaaaaaaaaaaaaaaa1", "123e4567-e89b-12d3-a456-426614174000", "C73BCDCC-2669-4Bf6-81d3-E4AE73FB11FD"):
        assert not secrets.markov_spans(text, model, secrets.base_spans(text))


def test_time_is_linear(spark):
    import time

    model = secrets.train(spark)
    path = "usr/local/Zx81kQpLw03vNmT7/" * 200_000  # one token of 5 MB
    many = " ".join(f"{k:016x}" for k in range(40_000))
    for text in (path, many):
        began = time.perf_counter()
        base = secrets.base_spans(text)
        secrets.markov_spans(text, model, base)
        assert time.perf_counter() - began < 30
