"""The operators of trellis.llm against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trellis.llm import boosting, components, divergence, mixing, mtree, pieces, pii, quality, secrets, simhash, suffixes, syncmers, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=()):
    """Documents, ids from 0; ``extra`` are further (id, text)."""
    rows = [*enumerate(texts), *extra]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i is not None else None, len(t) if t is not None else None) for i, t in rows], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


HARD = [None, "", " ", "\n\t", "a", "ünï ☃ 𝒳 text", "x" * 30_000, "word " * 20_000, "1" * 5000, "a" * 5000 + "@", "+1 " * 3000, "1.2." * 4000, "0123456789abcdef" * 400, "token " * 3000]

# --- spans -----------------------------------------------------------------------------------------------------------

PII_TEXTS = [
    "mail a.b+c@x-y.org, also q@w.e.r. and a@b", "☃ 𝒳 a@b.co 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "4111111111111111 4111111111111111", "call +49 (30) 123-456.78 or +1 2 or +1234567890123456",
    "a@b.com_x@y.org@z.net", "+1 555 0100 +1 555 0101", "x1.2.3.4y 01.002.0003.255", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "5500 0000 0000 0004 1",
]
PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}
SECRET_TEXTS = [
    'password = "hunter22"', "Token:abcdef api-key=zzzzzz API_KEY: 'a.b/c+d='", "secret==abcdef passwd : x1", "AKIA" + "A1" * 8 + " AKIAshort AKIA" + "B" * 15, "f" * 24 + "g" + "0" * 23, "PASSWORD:\"" + "x" * 50 + '"', "apikey   =   '123456' and token=12345", "☃ secret:𝒳abcdef secret: abcdefg",
]
SECRETS = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base(spark):
    texts = [*PII_TEXTS, *HARD]
    got = {r.doc_id: r for r in pii.report(docs_of(spark, texts, [(None, "a@b.c")])).collect()}
    for i, t in enumerate(texts):
        spans = {k: [(m.start(), m.end()) for m in p.finditer(t or "") if ok(m[0])] for k, (p, ok) in PII.items()} if len(t or "") < 6000 or i < len(PII_TEXTS) else None
        if spans is None:
            continue  # re itself is quadratic there; that the operator ends is the test
        assert {k: got[i][f"n_{k}"] for k in PII} == {k: len(v) for k, v in spans.items()}, t
        listed = ",".join(f"{k}:{s}:{e}" for k, v in spans.items() for s, e in v)
        assert got[i].base_sha256 == sha(listed.encode())
        assert set(listed.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[None].n_email == 1 and len(got) == len(texts) + 1


def test_pii_adds_spans_and_redacts(spark):
    t = "mail joe (at) foo dot com or call (030) 555-1234, visa 378282246310005, a@b.co; meet at one dot then."
    df = docs_of(spark, [t, None]).withColumn("base_email", F.lit("clash"))
    r = pii.report(df).orderBy("doc_id").first()
    assert r.n_email == 1 and r.spans == f"email:5:25,email:{t.index('a@b')}:{t.index('a@b') + 6},card:{t.index('3782')}:{t.index('3782') + 15},phone:{t.index('(030')}:{t.index('(030') + 14}"
    out = pii.redact(docs_of(spark, [t, None, "none"])).orderBy("doc_id").collect()
    assert out[0].text == "mail [EMAIL] or call [PHONE], visa [CARD], [EMAIL]; meet at one dot then." and out[0].n_chars == len(out[0].text)
    assert out[1].text == "" and out[2].text == "none"


def test_pii_learns_from_the_texts(spark):
    """Proposals that the texts themselves decide are examples: real numbers against those that only look alike."""
    rng = random.Random(21)
    dig = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        d = "4" + dig(14)
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if good else str((int(last) + 1) % 10))

    texts = []
    for _ in range(120):
        texts.append(f"pay {card(True)} or +1 ({dig(3)}) 555-{dig(4)} or ab{dig(2)}@host{dig(1)}.org")
        texts.append(f"seen {card(False)} from {rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)} not 300.{dig(2)}.1.{dig(1)} nor me@here")
    df = docs_of(spark, texts)
    got = Counter()
    for r in pii.decisions(df).collect():
        got[r.kind, r.label, r.accepted] += r.proposals
    assert got["card", 1, True] == 120 and got["card", 0, False] == 120 and not got["card", 0, True]
    assert got["phone", 1, True] == 120 and got["phone", 0, True] <= 2 and got["email", 0, True] == 0 and got["email", 1, True] == 120
    amex = pii.report(docs_of(spark, [*texts, "pay 378282246310005 or 378282246310006 now"])).orderBy(F.desc("doc_id")).first()
    assert amex.spans == "card:4:19" and amex.n_card == 0  # 15 digits, of which no text says anything but the checksum


def test_secrets(spark):
    texts = [*SECRET_TEXTS, *HARD, "ghp_" + "z" * 36]
    got = {r.doc_id: r for r in secrets.report(docs_of(spark, texts, [(None, "token: abcdef"), (0, SECRET_TEXTS[0])]).where("true")).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), o, m.end(), k) for o, (k, (p, ok)) in enumerate(SECRETS.items()) for m in p.finditer(t or "") if ok(m))
        assert got[i].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()), t
    assert got[len(texts) - 1].spans == "forge:0:40" and got[None].n_assign == 1


def test_only_candidates_are_verified(spark):
    """The index names the rows that hold all trigrams of a way; the others' texts are not verified, whatever they hold."""
    texts = [*SECRET_TEXTS, "swordfish passes the token", "nothing here", None, "Kiakiaki AKIA", "key to ken"]
    rows, queries = secrets.keyed(docs_of(spark, texts, [(3, texts[3])])), secrets.indexed_rules()
    assert set(secrets.RULES) - set(queries) == {"hex"}
    found = secrets.candidates(rows, queries)
    ids = {tuple(r[k] for k in secrets.KEY): r.doc_id for r in rows.collect()}
    got = {(ids[tuple(r[k] for k in secrets.KEY)], rule) for r in found.collect() for rule in r._trellis_rules}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = {(i, k) for i, t in enumerate(texts) for k, q in queries.items() if any(a <= grams((t or "").lower()) for a in q)}
    assert got == want and 0 < len({i for i, _ in want}) < len(texts)
    few = secrets.verified(rows, found.where(F.array_contains("_trellis_rules", "access")), ["access"]).collect()
    assert {ids[tuple(r[k] for k in secrets.KEY)] for r in few} == {i for i, k in want if k == "access"}  # a repeated row once


def test_secrets_with_clashing_columns(spark):
    df = docs_of(spark, ["token: abcdef", None], [(0, "token: abcdef")]).withColumn("at_assign", F.lit("clash")).withColumn("trigram", F.lit("x"))
    got = sorted((r.doc_id, len(r.at_assign), r.trigram) for r in secrets.find_secrets(df).collect())
    assert got == [(0, 1, "x"), (0, 1, "x"), (1, 0, "x")]


@pytest.mark.parametrize(("pattern", "query"), [("abcd", [["abc", "bcd"]]), ("ab?c", [[]]), ("foo(bar|baz)", [["foo", "oba", "oob", "bar"], ["foo", "oba", "oob", "baz"]]), ("[0-9]+abc", [["abc"]]), ("x*", [[]]), ("(?i:ABC)", [["abc"]])])
def test_trigram_queries(pattern, query):
    assert {frozenset(q) for q in query} == set(secrets.trigram_query(pattern))


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [None, "", "one", "one two", texts[3], "☃ 𝒳 " * 50]
    got = {r.doc_id: r for r in syncmers.report(docs_of(spark, texts)).collect()}
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after = whole[i - 1]  # by descending id, the last is followed by the first
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited.encode())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[len(texts) - 2].fingerprint
    long_ = [i for i in range(60) if len(whole[i]) > 600]
    assert np.mean([got[i].near_edited for i in long_]) > 0.4 and np.mean([got[i].near_next for i in long_]) < 0.1


def hashes(spark, rows, sql):
    return [r.h for r in spark.createDataFrame(rows).selectExpr(f"{sql} h").collect()]


def test_fingerprints_are_of_closed_syncmers(spark):
    words = [f"w{i * i % 23}" for i in range(60)]
    h = hashes(spark, [(w,) for w in words], "xxhash64(_1)")
    s = hashes(spark, list(zip(h, h[1:], strict=False)), "xxhash64(_1, _2)")
    want = [i for i in range(len(h) - 5) if min(s[i : i + 5]) in (s[i], s[i + 4])]
    got = syncmers.anchors(docs_of(spark, [" ".join(words), None, "a b c d e"])).orderBy("position").collect()
    assert [r.position for r in got] == want and 0.2 < len(want) / len(h) < 0.7
    whole = hashes(spark, [(s[i], s[i + 2], s[i + 4]) for i in want], "xxhash64(_1, _2, _3)")
    assert [r.anchor for r in got] == whole
    sketch = syncmers.report(docs_of(spark, [" ".join(words)])).first().fingerprint
    assert sketch == "".join(f"{x:08x}" for x in sorted({(a % (1 << 64)) >> 32 for a in whole})[:64])


def test_passages_by_position(spark):
    rng = random.Random(17)
    some = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = some(80)
    heads = [some(n) for n in (5, 30, 0)]
    texts = [" ".join([*x, *shared, *some(20)]) for x in heads] + [" ".join(some(200)), None]
    got = {(r.doc_id, r.other): r for r in syncmers.passages(docs_of(spark, texts, [(None, texts[0])])).collect()}
    assert set(got) == {(1, 0), (2, 0)} and got[1, 0].shift == 25 and got[2, 0].shift == -5
    for (i, _), r in got.items():
        assert len(heads[i]) <= r["first"] <= len(heads[i]) + 10 and len(heads[i]) + 69 <= r["last"] <= len(heads[i]) + 79
    assert syncmers.passages(docs_of(spark, []).where("false")).count() == 0


def test_next_document_over_ranges(spark):
    ids = [5, 900, 17, 3, 44, 45, 46, 100000, 2, 7]
    df = docs_of(spark, [], [(i, f"t{i}") for i in ids])
    got = {r.doc_id: r.next_text for r in syncmers.with_next(df, "text").collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert [r.next_text for r in syncmers.with_next(docs_of(spark, ["only"]), "text").collect()] == ["only"]


# --- tokens ----------------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(6)
    texts = [*HARD, "  two  spaces ", "▁mark▁", "</s> <s> <unk> <0x41>", "\x00\x01", "日本 　x", "a\r\nb\tc", "ﬁ Å é", "naïve café " * 50]
    texts += ["".join(rng.choice(" abcdeéß☃\n▁1.") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    got = {r.doc_id: r for r in pieces.encode(docs_of(spark, texts), "doc_id", with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].agrees
        assert got[i].ids_sha256 == sha(np.array(ids, "<u4").tobytes()) and got[i].decoded_sha256 == sha(sp.decode(ids).encode())
    back = pieces.decode(pieces.encode(docs_of(spark, ["a b", None]), "doc_id", with_ids=True)).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["a b", ""]


def test_the_library_decides(monkeypatch):
    """Where the agenda is wrong the ids are the library's, and the column says so; memory is bounded."""
    agenda = pieces.Agenda(pieces.default_model())
    texts = ["some words here", "x" * 500, "", "a " * 400, "one, two; three"]
    want = [pieces.pack(i) for i in agenda.library.encode(texts, add_bos=True, add_eos=True)]
    assert agenda.encode(texts) == [(w, True) for w in want] == agenda.encode(texts)
    assert agenda.known and max(map(len, agenda.known)) <= pieces.SHORT and {"e▁", "e,", ",▁"} <= agenda.seams and not agenda.wrong
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    agenda.encode(texts)
    agenda.encode(["six"])
    assert len(agenda.known) < 5
    right = agenda.word_ids
    monkeypatch.setattr(agenda, "word_ids", lambda w: [5] if w == "▁words" else right(w))
    agenda.known.clear()
    assert agenda.encode(texts) == [(w, i != 0) for i, w in enumerate(want)] == agenda.encode(texts)
    cut = agenda.parts  # parts whose seam is wrong: a merge goes over it
    monkeypatch.setattr(agenda, "parts", lambda t: ["▁th", "e"] if t == "the" else cut(t))
    the = pieces.pack(agenda.library.encode("the", add_bos=True, add_eos=True))
    assert agenda.encode(["the", "the", texts[4]]) == [(the, False), (the, False), (want[4], True)]


def test_sentencepiece_with_clashing_columns(spark):
    df = docs_of(spark, ["a b", None]).withColumn("ids", F.lit("clash")).withColumn("agrees", F.lit(3))
    out = pieces.encode(df, "doc_id", "agrees", "ids", "lang", with_ids=True)
    assert out.columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "agrees", "ids"] and all(r.agrees is True for r in out.collect())


# --- search ----------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "GROUP", 64)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (5, 12))
    x = np.vstack([centre[i % 5] + rng.normal(0, 0.2, 12) for i in range(700)]).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000, None, 0), (10_050, [1.0, None] + [0.0] * 10, 0), (None, [1.0] * 12, 0), (10_100, [float("nan")] * 12, 0), (10_150, [float("inf")] * 12, 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(vectors(spark, rows)).collect()}
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    want = {}
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:5]
        want |= {(i, k + 1): (j, s[j]) for k, j in enumerate(best)}
    assert got == want


def test_top_k_of_few(spark):
    assert mtree.top_k(vectors(spark, [])).count() == 0
    assert mtree.top_k(vectors(spark, [(50, [1.0], 0)])).count() == 0
    got = mtree.top_k(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (50, [0.0, 1.0], 0), (2, [], 0)])).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 256 * 128), (0, 2, 50, 0), (50, 1, 1, 256 * 128), (50, 2, 0, 0)]


def test_top_k_keeps_repeated_ids(spark):
    rows = [(50, [1.0, 1.0], 0), (52, [1.0, 1.0], 0), (52, [9.0, 9.0], 0), (50, [1.0, 1.0], 0), (7, [0.0, 0.0], 0)]
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(vectors(spark, rows)).collect())
    unit = 256 * 256
    assert got == {(50, 1, 52, 18 * unit): 2, (50, 2, 50, 2 * unit): 2, (50, 3, 52, 2 * unit): 2, (50, 4, 7, 0): 2}


def test_top_k_of_large_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "GROUP", 16)
    monkeypatch.setattr(mtree, "PAGE", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 6)).astype(np.float32)
    x[7], x[8], x[50], x[60:70] = 1e8, -1e30, 3e7, 1e12 * x[60:70]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    q = [[int(np.floor(256 * float(c))) for c in v] for v in x]
    want = {}
    for i in range(0, 300, 50):
        s = [sum(a * b for a, b in zip(q[i], q[j], strict=True)) for j in range(300)]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-float(s[j]), -min(max(s[j], mtree.LEAST), mtree.MOST), j))[:5]
        want |= {(i, k + 1): (j, min(max(s[j], mtree.LEAST), mtree.MOST)) for k, j in enumerate(best)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(vectors(spark, rows)).collect()}
    assert got == want and any(abs(s) == mtree.MOST for _, s in want.values())


def test_few_products_are_computed():
    """Inner nodes and pages are left out: in clustered data a query meets a small part."""
    rng = np.random.default_rng(6)
    centre = rng.normal(0, 40, (40, 8)) * 256
    x = np.floor(np.vstack([c + rng.normal(0, 64, (256, 8)) for c in centre]))
    longest = float((x * x).sum(axis=1).max())
    e = mtree._filled(x[::256], longest)
    far = mtree._far(e, e[:16])
    s = mtree.Shell(longest, e, e[:16], far.argmin(axis=1), far.min(axis=1))
    at, gap = s.nearest(x)
    s.radius = np.array([gap[at == i].max(initial=-np.inf) for i in range(len(e))])
    q = x[int((x * x).sum(axis=1).argmax())]
    floor = float(np.sort(x @ q)[-5])
    open_ = s.open_objects(q, floor)
    assert set(at[np.flatnonzero(x @ q >= floor)]) <= set(open_.tolist()) and len(open_) < len(e) // 2


# --- near and exact copies -------------------------------------------------------------------------------------------


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, within):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= within:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_texts():
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 300))) for _ in range(80)]
    near = []
    for t in base[:30]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "Changed"
            near.append(" ".join(w))
    return [*base, *near, *base[:5], None, "", " ", "ÀB Éé", "one TWO", "one two"]


def test_simhash(spark):
    texts = near_texts()
    fps = [brute_simhash(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    want = classes(fps, 2)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i], texts[i]
    kept = {r.doc_id for r in simhash.one_of_each_group(docs_of(spark, texts)).collect()}
    assert kept == set(want)


@pytest.mark.parametrize("hot", [simhash.HOT, 1, 5])
def test_simhash_of_dense_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # cells are divided by the second grid
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = classes(fps, 2)
    by: dict[int, set] = {}
    for f, c in zip(signed, want, strict=True):
        by.setdefault(c, set()).add(f)
    assert {f: min(s) for s in by.values() for f in s if f != min(s)} == got


def test_simhash_of_nulls_and_repeats(spark):
    df = docs_of(spark, ["a b c d", None], [(None, "a b c d"), (0, "a b c d"), (7, "")])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 0), (0, 0), (0, 0), (1, 1), (7, 1)]
    assert sorted(r.doc_id for r in simhash.one_of_each_group(df).collect()) == [0, 1]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each_group(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)] + [(2000, 2001 + i) for i in range(200)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000} | {2001 + i: 2000 for i in range(200)}


def repeated_texts():
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdé ☃") for _ in range(n))
    shared = [some(rng.randint(300, 900)) for _ in range(4)]
    texts = []
    for _ in range(40):
        texts.append("".join(some(rng.randint(0, 400)) + rng.choice(shared)[rng.randint(0, 60) :] for _ in range(rng.randint(0, 3))))
    return [*texts, texts[2], "x" * 1200, "xy" * 500, None, "", "short", some(399), "z" * 400, "z" * 400, "q" * 400]


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", 4)  # groups are split in blocks
    texts = repeated_texts()
    df = docs_of(spark, texts, [(None, texts[1]), (3, texts[3])])
    whole = [(t or "").encode() for t in texts] + [texts[1].encode(), texts[3].encode()]
    seen = Counter(b[p : p + 400] for b in whole for p in range(len(b) - 399))
    want = Counter()
    for i, b in zip([*range(len(texts)), None, 3], whole, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want[(i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(df).collect())
    assert got == want


def test_suffix_dedup_of_hot_grams_and_periods(spark, monkeypatch):
    """One line in many surroundings, of under and over 400 bytes, and texts of one period."""
    monkeypatch.setattr(suffixes, "MOST", 8)
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, long_ = "=" * 150 + some(160), some(450)
    texts = [some(rng.randint(0, 500)) + line + some(rng.randint(0, 500)) for line in [short, long_] for _ in range(40)]
    texts += ["abc" * 700, "xabc" * 500 + "tail", "z" * 5000, some(300) + "z" * 900]
    whole = [t.encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in whole for p in range(len(b) - 399))
    got = {r.doc_id: r for r in suffixes.without_repeats(docs_of(spark, texts), with_text=True).collect()}
    for i, b in enumerate(whole):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        assert bytes(got[i].kept) == bytes(np.frombuffer(b, np.uint8)[~gone]), i
    marked = next(suffixes._marked(iter([pa.RecordBatch.from_pydict({"k1": [1], "k2": [2], "text": ["ab" * 50_000]})])))
    assert marked.num_rows < 10  # a period is one mark


def test_deep_shallow_sorts():
    rng = random.Random(5)
    head = bytes(rng.choice(b"ab") for _ in range(100))
    s = [head[: rng.randint(60, 100)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [b"", head, head, b"a"]
    assert [s[i] for i in suffixes.deep_shallow(s, list(range(len(s))))] == sorted(s)


def test_windows_over_a_chunk(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    suffixes._tables.clear()
    data = bytes(random.Random(1).choice(b"abc") for _ in range(2300))
    a, lo, hi, _ = suffixes.marks(data)
    assert [p for x, y in zip(lo, hi, strict=True) for p in range(x, y + 1)] == list(range(len(data) - 399))
    assert all(p <= c <= p + 336 for c, x, y in zip(a, lo, hi, strict=True) for p in (x, y))
    suffixes._tables.clear()


# --- classifiers -----------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(12)
    plain = [f"{a}{b}" for a in ("ta", "ro", "min", "sel", "qua", "vor") for b in ("len", "dor", "mi", "sten", "ka")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "zorgle", "scum"])
        t = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "nobody", "en", "s", 6), (0, docs[0][1], "en", "s", 0), (n + 2, "x " * 50_000, "en", "s", 100_000)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int, toxic int")


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifier(spark, module, label, cut):
    from zlib import crc32

    docs, labels = labelled(spark)
    got = module.scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.95
    wrong = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.scores(docs.withColumn("lang", F.lit("de")), wrong).collect()}
    assert again == {r.doc_id: r.score for r in got}  # held-out labels and other columns change nothing
    assert module.scores(docs.limit(0), labels).count() == 0
    assert len({r.score for r in module.scores(docs, labels.limit(0)).collect()}) >= 1


def test_toxic_documents_go(spark):
    docs, labels = labelled(spark)
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    clean = {r.doc_id for r in labels.collect() if not r.toxic}
    assert len(kept & toxic) < 0.1 * len(toxic) and len(kept & clean) > 0.97 * len(clean)


def test_boosting_prints_as_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = boosting.fit(x, y, rounds=10)
    assert ((m.score(x) > 0.5) == y).mean() > 0.85
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = [r.s for r in df.selectExpr("i", f"{m.sql(['a', 'b', 'c'])} s").orderBy("i").collect()]
    assert np.allclose(got, m.score(x))
    at, rate = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all()


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 4}", 2) for i in range(4000)] + [(None, "a", "en", None, 1), (7, "t7", "en", "hot", 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copy_no", F.lit("clash"))
    out = mixing.mix(df, target=20_000)
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(by) <= {"hot", "s0", "s1", "s2", "s3", None}
    for s in ("hot", "s0", "s1", "s2", "s3"):
        assert abs(by[s] - 20_000 / 6) < 6 * (20_000 / 6) ** 0.5
    rows = out.collect()
    assert all(1 <= r.copy_no <= r.n_copies for r in rows)
    assert Counter((r.doc_id, r.copy_no) for r in rows if r.doc_id not in (7, None)).most_common(1)[0][1] == 1
    again = {(r.doc_id, r.copy_no, r.shuffle_key) for r in mixing.mix(df.repartition(3), target=20_000).collect()}
    assert again == {(r.doc_id, r.copy_no, r.shuffle_key) for r in rows}
    assert mixing.mix(df.limit(0)).count() == 0
    only = mixing.mix(df, weights={"s1": 1.0, "unheard": 3.0}).select("source").distinct().collect()
    assert {r.source for r in only} == {"s1"}


def test_mixing_counts_are_poisson(spark):
    from math import exp, factorial

    df = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(20_000)], SCHEMA)
    n = Counter(Counter(r.doc_id for r in mixing.mix(df, target=30_000).select("doc_id").collect()).values())
    for k in range(1, 6):
        p = exp(-1.5) * 1.5**k / factorial(k)
        assert abs(n[k] - 20_000 * p) < 6 * (20_000 * p) ** 0.5


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 300)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == docs.columns
        d = new
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in d.collect())
    assert got == Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    near = spark.read.parquet(str(tmp_path / "near-dedup"))
    fps = [brute_simhash(r.text) for r in near.collect()]
    assert len(set(classes(fps, 2))) == len(fps)


def test_empty_tables(spark):
    none = docs_of(spark, []).where("false")
    for f in (pii.report, secrets.report, syncmers.report, suffixes.without_repeats, lambda d: pieces.encode(d, "doc_id"), pii.redact):
        assert f(none).count() == 0


def test_examples_of_personal_data_come_from_every_document(spark):
    n = 2600
    docs = spark.range(n).selectExpr("id doc_id", "concat('please call +49 30 ', lpad(cast(id as string), 7, '0'), ' or pay by card 4', lpad(cast(id as string), 15, '0')) text")
    rows = pii._real(docs.unionByName(docs.where("doc_id < 10")))
    cards = [r for r in rows if pii.KINDS[r.k] == "card" and r.digits == 16]
    assert sum(r["count"] for r in cards) == n + 10
    assert sum(r["count"] for r in cards if r.label == 1) == sum(luhn("4" + str(i).zfill(15)) for i in [*range(n), *range(10)])


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def test_terms_are_counted_without_a_pass_over_pairs_of_neighbours(spark):
    texts = ["b A a, ÄÄ a B", None, "", "zz", "!!", "a a", "Straße STRASSE É é"]
    docs = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    counts = divergence.term_counts(docs)
    got = {r.term: (r.n, r.docs) for r in counts.collect()}
    assert got == {"a": (5, 2), "b": (2, 1), "ÄÄ": (1, 1), "zz": (1, 1), "straße": (1, 1), "strasse": (1, 1), "É": (1, 1), "é": (1, 1)}
    assert "lambdafunction" not in counts._jdf.queryExecution().optimizedPlan().toString()
