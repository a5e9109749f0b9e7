"""The pipeline's near-dedup stage against brute force over five-word shingles."""

from __future__ import annotations

import re

import numpy as np
import pytest

from trellis.llm import alike

from .test_llm import brute_simhash, docs_of


def shingled(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def least_of_groups(texts):
    """The least place of each group: linked by similarity of at least 0.8, or by fingerprints within two bits."""
    sets, fps, root = [shingled(t) for t in texts], [brute_simhash(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    only_similar = 0
    for i in range(len(texts)):
        for j in range(i):
            bits, like = (fps[i] ^ fps[j]).bit_count() <= 2, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
            only_similar += like and not bits
            if bits or like:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}, only_similar


def test_near_copies_by_five_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(3000)}"
    line = [word() for _ in range(30)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(int(rng.integers(8, 120)))] + (line if k % 2 else [])
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5):
            w = list(base)
            for at in rng.integers(0, len(w), edits):
                w[at] = word()
            texts.append(" ".join(w))
    texts += [None, "", " ".join(line), " ".join(line).upper(), "a b c", "a b c d e f", "b c d e f a", *texts[:3]]
    want, only_similar = least_of_groups(texts)
    assert only_similar > 20  # pairs that two of 64 bits don't reach
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts), "").collect()}
    assert got == want


def test_similar_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(60)]
    sets += [s[:-1] for s in sets[:20] if len(s) > 1]
    want = [[5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y)) for y in sets] for x in sets]
    assert (alike.similar_sets(sets, columns=7) == np.array(want)).all()


def test_common_shingles():
    import pyarrow as pa

    texts = ["a b c d e f", "x a b c d e", "a b c d e f", "q r s t u v"]
    got = next(alike._often(iter([pa.RecordBatch.from_pydict({"key": [1, 2, 1, 3], "text": texts})])))
    assert got.column("n").to_pylist() == [2] and got.column("token").to_pylist() == [int(s) for s in np.intersect1d(alike.shingles(texts[0]), alike.shingles(texts[1]))]


@pytest.mark.parametrize(("small", "cell"), [(8, 2000), (2, 7), (1000, 7)])
def test_large_group_and_bounded_order(spark, monkeypatch, small, cell):
    """Few shingles in the order, pairs that no hub is part of, cells and blocks: none changes the result."""
    monkeypatch.setattr(alike, "COMMON", 10)
    monkeypatch.setattr(alike, "SMALL", small)
    monkeypatch.setattr(alike, "CELL", cell)
    rng = np.random.default_rng(5)
    base = [f"v{k}" for k in range(100)]
    texts = []
    for _ in range(90):
        w = list(base)
        for at in rng.integers(0, 100, int(rng.integers(1, 7))):
            w[at] = f"x{rng.integers(10_000)}"
        texts.append(" ".join(w))
    want, _ = least_of_groups(texts)
    assert {r.doc_id for r in alike.one_of_each_group(docs_of(spark, texts)).collect()} == want
    assert alike.one_of_each_group(docs_of(spark, []).where("false")).count() == 0


def test_shingles_that_meet():
    """Held against all pairs, over batches that cut a token's rows; what pairs need always stays."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    rows = sorted({(int(t), int(k) % 7, int(k), 1 + int(k) * 3 % 40) for t, k in rng.integers(0, 30, (400, 2))})
    names = ["token", "root", "key", "n"]
    batches = [pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows[k : k + 17]], pa.int32() if c == "n" else pa.int64()) for i, c in enumerate(names)}) for k in range(0, len(rows), 17)]
    got = {tuple(r[c] for c in names) for b in alike._meeting(iter(batches)) for r in b.to_pylist()}
    want = {r for r in rows if any(o[0] == r[0] and o[1] != r[1] and 4 * max(o[3], r[3]) <= 5 * min(o[3], r[3]) for o in rows)}
    assert got == want and 0 < len(want) < len(rows)
    assert list(alike._meeting(iter([]))) == []


def test_first_of_groups_null_and_repeated_ids(spark):
    from trellis.llm.simhash import first_of_groups
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (2, "b"), (None, "c"), (None, "c"), (5, None)], "doc_id long, text string")
    placed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    one = lambda root: [tuple(r) for r in first_of_groups(docs, placed.withColumn("root", root)).collect()]
    got = one(F.col("text_key"))
    assert len(got) == 4 and set(got) == {(2, "a"), (2, "b"), (None, "c"), (5, None)}
    assert len(one(F.lit(1))) == 1 and one(F.lit(1))[0][0] == 2
    assert first_of_groups(docs.where("false"), placed.where("false").withColumn("root", F.lit(1))).count() == 0


def test_whole_sets_are_moved_in_waves(spark, monkeypatch):
    """However many pairs and blocks there are, a wave has few, and all together give every link."""
    from pyspark.sql import functions as F

    for name, to in {"PAIRS": 200, "ROWS": 40, "SMALL": 2, "CELL": 12}.items():
        monkeypatch.setattr(alike, name, to)
    waves, held = {}, alike._in_waves
    monkeypatch.setattr(alike, "_in_waves", lambda n, rows, found, name: waves.update({name: n}) or held(n, rows, found, name))
    rng = np.random.default_rng(5)
    base, texts = [f"v{k}" for k in range(100)], []
    for _ in range(30):
        w = list(base)
        for at in rng.integers(0, 100, int(rng.integers(1, 7))):
            w[at] = f"x{rng.integers(10_000)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sets = [shingled(t) for t in texts]
    want = {(a, b) for b in range(30) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    pairs = df.select(F.col("key").alias("a")).crossJoin(df.select(F.col("key").alias("b"))).where("a < b")
    found = alike._verified(pairs.withColumns({"many": F.lit(3).cast("long"), "need": F.lit(3).cast("long")}), df)
    assert {tuple(r) for r in found.collect()} == want and 10 < len(want) < 400

    placed = df.select(F.lit(1).cast("long").alias("token"), F.col("key").alias("root"), "key", F.lit(96).alias("n")).repartition(1).sortWithinPartitions("token", "root", "key")
    links = {tuple(sorted(r)) for r in alike._linked_in_cells(placed, df.select("key", F.col("key").alias("root")), df).collect()}

    def groups(links):
        least = list(range(30))
        for _ in range(30):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert groups(links) == groups(want)
    assert waves == {"similar": 3, "compared": 3}


def test_shingles_shared_by_chance(spark, monkeypatch):
    """Shingles that many unrelated texts have don't make candidates of texts with rare ones, though none of them is in the list of common ones."""
    monkeypatch.setattr(alike, "COMMON", 0)
    rows, held = {}, alike.written
    monkeypatch.setattr(alike, "written", lambda df, name, *rest: rows.setdefault(name, []).append(held(df, name, *rest)) or rows[name][-1])
    monkeypatch.setattr(alike, "dropped", lambda table: None)
    rng = np.random.default_rng(8)
    lines = [" ".join(f"l{k}w{i}" for i in range(7)) for k in range(20)]
    texts = [" ".join(" ".join([lines[k], *(f"u{rng.integers(1 << 40)}" for _ in range(6))]) for k in rng.permutation(20)[:12]) for _ in range(150)]
    texts.append(texts[0] + " more")
    want, _ = least_of_groups(texts)
    assert {r.doc_id for r in alike.one_of_each_group(docs_of(spark, texts)).collect()} == want and len(want) == 150
    assert rows["shared"][0].select("key").distinct().count() <= 2 and rows["cells"][0].count() == 0
