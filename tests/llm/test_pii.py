import hashlib
import random
import re

import pytest

from tallyleaf.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }
    return ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in out[k])


@pytest.mark.parametrize("seed", range(8))
def test_base_kinds_equal_the_patterns(seed):
    rng, anchors = random.Random(seed), pii.automaton()
    for _ in range(1500):
        text = "".join(rng.choice("aé0123456789.@+-() %\n_1.1.@4") for _ in range(rng.randrange(0, 60)))
        assert pii.joined(pii.find(text, anchors), pii.BASE) == brute(text), text


def test_known_spans():
    text = "write a.b@c.org or call +1 (988) 555-2485, card 4337166598464399, 10.0.0.1, see https://x.org/a. account: DE12 3456, token = \"1beb58b8af68854f\", 12 Baker street"
    found = pii.find(text, pii.automaton())
    assert {k: len(v) for k, v in found.items() if v} == {"email": 1, "phone": 1, "card": 1, "ip": 1, "url": 1, "account": 1, "secret": 1, "address": 1}
    assert "a.b@c.org" not in pii.redact(text)


def test_rows(spark):
    long = "x" * 300_000 + " a@b.co"
    rows = [(1, None, 9), (2, "", 9), (None, "a@b.co", 9), (4, long, 9), (4, long, 9)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 3
    assert {r.base_sha256 for r in got if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_secrets_are_taken_whole():
    token = "eyJhbGciOi." + "aB3_-x" * 100 + ".c2ln" + "Z" * 40
    text = f"say token: {token} and go on"
    assert pii.find(text, pii.automaton())["secret"] == [(11, 11 + len(token))]
    assert pii.redact(text) == "say token: [secret] and go on"
