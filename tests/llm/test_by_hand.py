"""Classifiers and the pipeline's stages worked out again in plain Python, from what was learnt and from the rows alone."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trellis.llm import alike, boosting, mixing, pieces, pii, quality, toxicity

from .test_llm import brute_simhash, labelled

# --- toxicity --------------------------------------------------------------------------------------------------------


def toxic_features(text, learnt):
    """The twenty numbers, in loops."""
    raw, low = text.split(), [w.strip(toxicity._TRIM) for w in text.lower().split()]
    n, chars = max(len(raw), 1), max(len(text), 1)
    hits = {"g": [], "w": [], "s": []}
    for i, w in enumerate(low):
        if w in toxicity.GENERAL:
            hits["g"].append(i)
        if w in learnt:
            hits["w"].append(i)
        if w[: toxicity.STEM] + "~" in learnt:
            hits["s"].append(i)
    mixed = re.compile(r"[^\W\d_][\d@$*]+[^\W\d_]")
    disguised = sum(1 for w in raw if mixed.search(w) and (p := w.lower().translate(toxicity._UNDO)) and (p in toxicity.GENERAL or p in learnt))
    second = [i for i, w in enumerate(low) if w in toxicity.SECOND]
    near = sum(1 for i in {i for x in hits.values() for i in x} if any(abs(i - j) <= 6 for j in second))
    out = []
    for x in hits.values():
        out += [len(x) / n, len(x), len({low[i] for i in x})]
    same = sum(1 for i in range(1, len(low)) if low[i] == low[i - 1])
    return [*out, disguised, near / n, near, len(second) / n, sum(1 for c in text if c.isupper()) / chars, len(re.findall(r"[^\w\s]", text)) / chars, text.count("!") / n,
            len(re.findall(r"(\w)\1{3,}", text)) / n, len(mixed.findall(text)) / n, same / n, math.log(1 + len(raw))]


def walked(tree, f):
    while tree.feature >= 0:
        tree = tree.left if f[tree.feature] < tree.cut else tree.right
    return tree.value


def between(x, at, rate):
    """The calibrated rate: a line between the knots around."""
    if x <= at[0]:
        return rate[0]
    for a, b, p, q in zip(at, at[1:], rate, rate[1:], strict=False):
        if a <= x < b:
            return p + (q - p) * (x - a) / (b - a)
    return rate[-1]


def toxic_scores(texts, model):
    learnt, trees, at, rate = model
    at, rate = at.tolist(), rate.tolist()
    return [between(trees.base + sum(walked(t, f) for t in trees.trees), at, rate) for f in (toxic_features(t or "", learnt) for t in texts)]


def test_toxicity_by_hand(spark):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.limit(5).select("doc_id", F.lit("You are such an 1d10t idiot!!! zorgle SCUM aaaaah you you x1x").alias("text"), "lang", "source", "n_chars"))
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    model = toxicity.fit(docs, labels)
    kept = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    out = {}
    for b in toxicity._scored(*model)(iter(kept.select("doc_id", "text").toArrow().to_batches())):
        out |= dict(zip(b.column("doc_id").to_pylist(), b.column("score").to_pylist(), strict=True))
    assert set(out) == set(texts)
    want = dict(zip(texts, toxic_scores(texts.values(), model), strict=True))
    assert all(abs(out[i] - want[i]) < 1e-9 for i in texts)
    found = docs.collect()
    own = Counter((r.doc_id, round(r.score, 9)) for r in toxicity.scores(docs, labels).collect())
    assert own == Counter((r.doc_id, round(s, 9)) for r, s in zip(found, toxic_scores([r.text for r in found], model), strict=True))


def test_isotonic_by_hand():
    """A block's rate is the largest, over its left ends, of the least means to the right; smoothed by one row of either class."""
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 25)
        y = np.array([rng.randint(0, 1) for _ in range(n)], float)
        at, rate = boosting.isotonic(np.arange(n, dtype=float), y)
        fit = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        blocks, k = [], 0
        while k < n:
            m = k
            while m + 1 < n and abs(fit[m + 1] - fit[k]) < 1e-12:
                m += 1
            blocks.append((k, m, (y[k : m + 1].sum() + 0.5) / (m - k + 2)))
            k = m + 1
        want = np.maximum.accumulate([r for a, b, r in blocks for _ in (a, b)])
        assert at.tolist() == [x for a, b, _ in blocks for x in (a, b)] and np.allclose(rate, want, atol=1e-12)


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_by_hand(spark):
    docs, labels = labelled(spark)
    words, net = quality.fit(docs, labels)
    v = len(words.ids)

    def score(text):
        toks, last = [], ""
        for t in re.findall(r"[^\W_]+|[^\w\s]+|_+", text):
            low = t.lower()
            toks.append(low)
            toks += ["\x01caps"] * (t.isupper() and len(t) > 1) + ["\x01again"] * (low == last) + ["\x01signs"] * (not t[0].isalnum() and len(t) > 1)
            last = low
        f = [0.0] * (quality.DIM + 2)
        if toks:
            many = Counter(words.ids.get(t, v + crc32(t.encode()) % quality.SLOTS) for t in toks)
            for d in range(quality.DIM):
                f[d] = sum(float(words.vectors[i][d]) * c for i, c in many.items()) / len(toks)
            f[quality.DIM], f[quality.DIM + 1] = math.log(1 + len(toks)) / 8, len(set(toks)) / len(toks)
        hidden = [max(0.0, sum((f[i] - net.shift[i]) / net.scale[i] * net.w1[i][j] for i in range(len(f))) + net.b1[j]) for j in range(len(net.b1))]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, logit))))

    some = docs.where("doc_id % 8 = 0 or doc_id is null or doc_id >= 600").collect()
    got = Counter()
    for r in quality.scores(docs, labels).where("doc_id % 8 = 0 or doc_id is null or doc_id >= 600").collect():
        got[r.doc_id, round(r.score, 4), r.predicted] += 1
    want = Counter((r.doc_id, round(s := score(r.text or ""), 4), int(s >= 0.3)) for r in some)  # pooled in single precision
    off = [(a, b) for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True) if a[0] != b[0] or abs(a[1] - b[1]) > 3e-4 or a[2] != b[2]]
    assert not off and sum(got.values()) == sum(want.values())


# --- near copies -----------------------------------------------------------------------------------------------------


def test_common_shingles_by_histogram(spark, monkeypatch):
    """Which shingles come last changes nothing but the work; and never more than COMMON are gathered."""
    texts = spark.createDataFrame([(i, f"a b c d e {i % 40} f g h i j {i % 7} k") for i in range(400)], "key long, text string").coalesce(1)
    whole = {int(t): int(n) for t, n in alike._most_common(texts)}
    count = Counter(t for r in texts.collect() for t in alike.shingles(r.text).tolist())
    assert whole == {t: n for t, n in count.items() if n >= alike.OFTEN}  # one chunk: exact counts
    monkeypatch.setattr(alike, "COMMON", 20)
    some = alike._most_common(texts)
    assert 0 < len(some) <= 20 and min(n for _, n in some) >= max([n for t, n in whole.items() if t not in {int(x) for x, _ in some}])
    monkeypatch.setattr(alike, "COMMON", 0)
    assert len(alike._most_common(texts)) == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def stays(rows):
    """Of each group of near copies the row with the smallest id, null last."""
    sets, fps, root = [shingles(r.text) for r in rows], [brute_simhash(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i].text or "") == (rows[j].text or "") or (fps[i] ^ fps[j]).bit_count() <= 2 or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return Counter(None if null else i for null, i in best.values())


def poisson(row, rate):
    key = str(row.doc_id) if row.doc_id is not None else hashlib.md5((row.text or "").encode()).hexdigest()
    n, total = math.ceil(rate / mixing.PIECE), 0
    for i in range(n):
        part = rate / n
        u = int(hashlib.md5(f"7:{'' if i == 0 else f'{i}:'}{key}".encode()).hexdigest()[:13], 16) / 2**52
        p = f = math.exp(-part)
        k = 0
        while f < u and k < part + 14 * math.sqrt(part) + 40:
            k += 1
            p *= part / k
            f += p
        total += k
    return total


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, labels = labelled(spark, 260)
    rng = random.Random(3)
    rows = [r for r in docs.collect() if len(r.text or "") < 10_000]
    schema = docs.schema
    clean = [r for r in rows if r.doc_id is not None and len((r.text or "").split()) > 40]
    more = []
    for k, r in enumerate(clean[:25]):
        w = r.text.split()
        w[rng.randrange(len(w))] = "changed"
        more.append((1000 + k, " ".join(w), "en", f"src{k % 3}", 0))
    more += [(2000 + k, f"write to joe{k}@host.org or 4111 1111 1111 1111 from 10.0.0.{k} now {' '.join(rng.choices(['ta', 'ro', 'mi', 'sel'], k=12))}", "de", "src9", 0) for k in range(8)]
    rows = [(r.doc_id, r.text, r.lang, ["s0", "s1", None, "s2"][(r.doc_id or 0) % 4] if r.doc_id is not None else "s0", r.n_chars) for r in rows]
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([*rows, *more], schema).write.parquet(str(top / "documents.parquet"))
    labels.write.parquet(str(top / "labels.parquet"))
    return str(top)


def test_every_stage_by_hand(spark, corpus, tmp_path):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")

    def after(name, before):
        stage[name](spark, before, corpus).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    whole = lambda df: Counter(tuple(r) for r in df.collect())
    model = toxicity.fit(docs, labels)
    rows = docs.collect()
    clean = after("toxicity", docs)
    assert whole(clean) == Counter(tuple(r) for r, s in zip(rows, toxic_scores([r.text for r in rows], model), strict=True) if s < 0.5) and 0 < clean.count() < len(rows)

    single = after("near-dedup", clean)
    kept = single.collect()
    assert Counter(r.doc_id for r in kept) == stays(clean.collect()) and len(kept) < clean.count() - 5
    assert not whole(single) - whole(clean)

    public = after("pii", single)
    spans = {r.doc_id: r.spans for r in pii.report(single).collect()}
    want = Counter()
    for r in kept:
        t, at, out, end = r.text or "", 0, [], -1
        for s, e, k in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in spans[r.doc_id].split(",") if x):
            if s < end:
                end = at = max(end, e)
                continue
            out += [t[at:s], f"[{k.upper()}]"]
            at = end = e
        t = "".join([*out, t[at:]])
        want[(r.doc_id, t, r.lang, r.source, len(t))] += 1
        if r.doc_id is not None and r.doc_id >= 2000:
            assert {"email", "card", "ip"} <= {x.split(":")[0] for x in spans[r.doc_id].split(",")} and not re.search(r"@|4111|10\.0\.0", t)
    assert whole(public) == want

    mixed = after("mixing", public)
    rows = public.collect()
    of = Counter(r.source for r in rows)
    copies = Counter()
    for r in rows:
        copies[tuple(r)] += poisson(r, (float(len(rows)) * (1.0 / len(of))) / of[r.source])
    assert whole(mixed) == +copies

    ids = after("sentencepiece", mixed)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = Counter()
    for r in mixed.collect():
        x = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want[(r.doc_id, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest(), tuple(x))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in ids.collect()) == want
