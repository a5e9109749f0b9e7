"""Random texts of the characters that matter: spans against Python's re, whose searches are leftmost as well."""

from __future__ import annotations

import hashlib
import random
import re

from trellis.llm import pii, secrets

from .test_llm import PII, SECRETS, docs_of, luhn

ALPHABETS = ["ab.@-_%+c@.d", " 01.25@x.3-", "4111 -0123456789", " +(0)12.-345678 9", "+12345 ()-.", "1.2.3.45.255.256.x ", "☃é𝒳 1@a.b+4 -"]
WORDS = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "AKIA", "'", '"', " ", ":", "=", "abcdef", "x", "0123456789abcdef0123456789", "Z", "ſecret", "toKen"]


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


#: Letters in either case, of ASCII alone.
ASSIGN = re.compile("(?:" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_pii_spans(spark):
    rng = random.Random(77)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in ALPHABETS for _ in range(250)]
    for _ in range(300):
        d = [rng.randint(0, 9) for _ in range(rng.randint(15, 20))]
        d[-1] = next(k for k in range(10) if luhn("".join(map(str, [*d[:-1], k]))))
        texts.append(rng.choice(["", "1", "x ", "9 ", "9-"]) + "".join(f"{x}{rng.choice(['', '', '', ' ', '-', '  ', '--'])}" for x in d) + rng.choice(["", " 1", "-", "x"]))
    got = {r.doc_id: r.base_sha256 for r in pii.report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == digest([(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in p.finditer(t) if ok(m[0])]), t


def test_secret_spans(spark):
    rng = random.Random(78)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    rules = SECRETS | {"assign": (ASSIGN, SECRETS["assign"][1])}
    got = {r.doc_id: r.base_sha256 for r in secrets.report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), o, m.end(), k) for o, (k, (p, ok)) in enumerate(rules.items()) for m in p.finditer(t) if ok(m))
        assert got[i] == digest([(k, s, e) for s, _, e, k in found]), t
