"""Components of links against union-find, and the number of jobs that the driver keeps account of."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from trellis.llm import components


def by_hand(links: list[tuple[int, int]]) -> dict[int, int]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root if top(x) != x}


def some_links(seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    ids = list({rng.getrandbits(63) - (1 << 62) for _ in range(3_000)})
    chain = list(zip(ids[:700], ids[1:700], strict=False))
    low, high = min(ids[1_000:1_500]), max(ids[1_500:2_000])  # hubs that are smaller and larger than all near them
    stars = [(low, x) for x in ids[1_000:1_500]] + [(x, high) for x in ids[1_500:2_000]]
    rest = [tuple(rng.choices(ids[2_000:], k=2)) for _ in range(600)]
    links = chain + stars + rest + rest[:100] + [(ids[0], ids[0])]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_union_find(spark, seed):
    links = some_links(seed)
    rows = [*links, (None, 1), (1, None)]
    got = [tuple(r) for r in components.components(spark.createDataFrame(rows, "a long, b long").repartition(7)).collect()]
    want = by_hand(links)
    assert len(got) == len(want) and dict(got) == want


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [1, 5, 1 << 18])
def test_small_stars_across_batches(monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rows = sorted({(max(x), min(x)) for x in some_links(3) if x[0] != x[1]})
    rows = sorted(rows + rows[:50])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*rows[k : k + 3], strict=True)], names=["hi", "lo"]) for k in range(0, len(rows), 3)]
    got = [tuple(x.values()) for b in components._small_stars(iter(batches)) for x in b.to_pylist()]
    assert by_hand(got) == by_hand(rows)
    assert all(hi > lo for hi, lo in got) and len(got) <= len(rows)


def test_jobs_of_components(spark):
    """The driver's memory grows with the jobs and plans it keeps account of, so a component takes few of them."""
    links = spark.createDataFrame(some_links(1), "a long, b long").repartition(7)
    spark.sparkContext.setJobGroup("components", "components")
    try:
        components.components(links).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 30
