"""Fill-in-middle, divergence of sources and decontamination against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.llm import divergence, infill, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n", "\n\n\n", "a", "a\nb\nc", "ends\n", "ünï ☃\n𝒳 text\r\nx", "line\n" * 4000, "word " * 20_000, "<P>", "a\n<S>b", "has <M> in it", "<P\nS>\n<", "<\n<P", "M>\n<S\n>"]
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def docs_of(spark, rows):
    """Documents from (id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], SCHEMA)


# --- fill-in-middle --------------------------------------------------------------------------------------------------


def cut_by_hand(i, t):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n, h = len(units), sha(f"7:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return i, n, "plain", None, None, sha(t), sha(t), t
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < 50 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return i, n, form, len(p), len(m), sha(out), sha(t), out


def test_infill(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(HARD * 4)] + [(None, "no\nid\n", None, None), (3, HARD[3], "en", "s")]
    got = infill.fill_in_middle(docs_of(spark, rows).withColumn("n", F.lit("clash")).withColumn("output", F.lit("clash")))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256, r.output) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(found, key=key) == sorted((cut_by_hand(i, t) for i, t, _, _ in rows), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = got.select(F.coalesce("text", F.lit("")).alias("t"), infill.restore(F.col("output"), F.col("form")).alias("b"))
    assert back.where("t <> b or b is null").count() == 0


def test_infill_rates_units_and_empty(spark):
    df = docs_of(spark, [(k, f"one two\nthree {k}\n", "en", "s") for k in range(400)])
    forms = Counter(r.form for r in infill.fill_in_middle(df, rate=30, suffix_first=0).collect())
    assert set(forms) == {"plain", "psm"} and 80 < forms["psm"] < 160
    words = infill.fill_in_middle(df.limit(1), unit=r"\S+\s*", with_output=False).first()
    assert words.n == 4 and "output" not in words
    assert infill.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, rate=101)
    with pytest.raises(ValueError):
        infill.unit_ends("a b", regex.compile("[a-z]"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\na☃", max_size=40), st.integers(0, 50))
def test_infill_round_trip(text, i):
    out, form, *_ = infill.cut(text, str(i), regex.compile(infill.LINES))
    assert infill.restored(out, form) == text


# --- divergence ------------------------------------------------------------------------------------------------------


def audit_by_hand(rows, least=10, top=10):
    total, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        langs[lang].add(source)
        total[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter({t: sum(total[lang, s][t] for s in sources) for t in kept})

        def parts(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = parts(whole), {s: parts(total[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if total[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, v, k + 1))
    return out


def test_divergence(spark):
    rng = random.Random(3)
    vocab = ["The", "naïve", "Été", "été", "ÉTÉ", "cat's", "x2y", "dog", "☃", "İstanbul", "ein", "zwei"]
    rows = [(k, " ".join(rng.choices(vocab, weights=[1 + (k * j) % 5 for j in range(len(vocab))], k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", None, "ü"])) for k in range(300)]
    rows += [(1000, None, "en", "silent"), (1001, "only once", "xx", "a"), (1002, "", "xx", "b"), (1003, "42 !", "yy", "a")] + [rows[5]] * 3
    got = divergence.audit(docs_of(spark, rows).withColumn("term", F.lit("clash")).withColumn("p", F.lit(1)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit_by_hand(rows)
    assert ("xx", "a", "pair", "b", 0, 1) in found and not [r for r in found if r[0] == "yy"]
    few = {tuple(r) for r in divergence.audit(docs_of(spark, rows), least_docs=1, top=2).collect()}
    assert few == audit_by_hand(rows, 1, 2)
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_divergence_of_large_counts(spark):
    """Counts whose product with 10^9 is beyond 64 bits."""
    big = 10**12 + 7
    kept = spark.createDataFrame([("en", "x", 2 * big, {"a": big, "b": big}), ("en", "y", 5, {"a": 5})], "lang string, term string, n long, by_source map<string,long>")
    docs = docs_of(spark, [(0, "", "en", "a"), (1, "", "en", "b"), (2, "", "en", "c")])
    wide = divergence.vectors(kept, divergence.languages(docs, kept))
    part = lambda c, n: 1 + 10**9 * (c + 2) // (n + 4)
    got = {r.term: (r.q, r.p) for r in wide.collect()}
    totals = (big + 5, big, 0)
    assert got["x"] == (part(2 * big, 2 * big + 5), [part(c, n) for c, n in zip((big, big, 0), totals, strict=True)])
    assert got["y"] == (part(5, 2 * big + 5), [part(c, n) for c, n in zip((5, 0, 0), totals, strict=True)])


# --- decontamination -------------------------------------------------------------------------------------------------


def words_by_hand(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def hits_by_hand(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_by_hand(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words_by_hand(t), set(), set()
        for k in range(len(w)):
            for m in range(1, 11):
                if k + m <= len(w) and (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def contaminated_texts():
    rng = random.Random(11)
    vocab = ["the", "of", "and", "été", "x1", "Fox", "dog", "ran", "☃", "in", "a", "b", "c"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, say(rng.randint(10, 40))) for k in range(30)] + [(100, "a " * 25), (101, "a b " * 12), (102, say(10)), (103, None), (104, "!?"), (None, say(12)), (105, say(11)), (105, say(13))]
    docs = [(k, say(rng.randint(0, 60))) for k in range(60)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
        docs += [(200 + k, say(20) + ". " + (t or "").upper().replace("É", "é") + "\n" + say(5)), (300 + k, say(7) + "-" + ",".join(w[a:b]) + "! " + say(9)), (400 + k, " ".join(w[:9])), (500 + k, " ".join(w[1:11])), (600 + k, t)]
    docs += [(700, None), (701, ""), (702, "a " * 3000), (703, items[0][1] + " " + items[1][1]), (None, items[2][1]), (None, "clean"), (704, items[3][1]), (704, items[3][1]), (705, (items[4][1] + " zz ") * 50)]
    return docs, items


def frames(spark, docs, items):
    d = docs_of(spark, [(i, t, "en", "s") for i, t in docs]).withColumns({"h": F.lit(1), "at": F.lit(2), "items": F.lit("clash")})
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("few", [winnowing.FEW, 0])
def test_decontamination(spark, monkeypatch, few):
    monkeypatch.setattr(winnowing, "FEW", few)
    docs, items = contaminated_texts()
    assert rows_of(winnowing.report(*frames(spark, docs, items))) == hits_by_hand(docs, items)
    short = [*items, (800, "fox"), (801, "the dog ran"), (802, "a b c a b c a b c"), (803, "ran ran"), (804, "of of")]
    assert rows_of(winnowing.report(*frames(spark, docs, short))) == hits_by_hand(docs, short)


def test_decontamination_spans_and_empty(spark):
    t = "one two three four five six seven eight nine ten eleven"
    d, b = frames(spark, [(1, f"x {t} y {t}"), (2, t.rsplit(" ", 2)[0])], [(7, t), (8, t[4:] + " z")])
    got = {r.doc_id: r for r in winnowing.contamination(d, b).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 12), (13, 24)] and got[1]["items"] == ["7", "8"] and got[2].spans == [] and not got[2].contaminated
    assert winnowing.report(d.limit(0), b).count() == 0
    assert [r.n_hit for r in winnowing.report(d, b.limit(0)).collect()] == [0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=10), st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_every_window_holds_a_fingerprint(window, before, after):
    """What the choice of grams must guarantee, on its plain form: one of a window's grams is the least there."""
    text = before + window + after
    grams = [hash(tuple(text[i : i + winnowing.GRAM])) for i in range(len(text) - winnowing.GRAM + 1)]
    least = [min(grams[i : i + winnowing.NEXT]) for i in range(len(grams) - winnowing.NEXT + 1)]
    chosen = {i for i, g in enumerate(grams) if any(least[j] == g for j in range(max(0, i - winnowing.NEXT + 1), min(i + 1, len(least))))}
    own = [hash(tuple(window[i : i + winnowing.GRAM])) for i in range(winnowing.NEXT)]
    at = {i for i, g in enumerate(own) if g == min(own)}
    assert {len(before) + i for i in at} <= chosen
