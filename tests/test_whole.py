"""Queries over the whole of their inputs."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

from trellis import catalog
from trellis.plans import graph
from trellis.sources import tables

from .test_queries import TABLES, con, rows  # noqa: F401


def test_k_paths_to_every_part(spark):
    down = defaultdict(set)
    for r in graph.dag(spark, TABLES).edges.select("source", "target").collect():
        down[r.source].add(r.target)
    parts = {f"part{r.p_partkey}" for r in tables.read(spark, TABLES, "part").collect()}
    found, level = defaultdict(list), [("ROOT",)]
    for _ in range(3):
        level = [(*p, t) for p in level for t in down[p[-1]] if t not in p]
        for p in level:
            if p[-1] in parts:
                found[p[-1]].append((float(len(p) - 1), ">".join(p)))
    want = {(b, k + 1, path, cost) for b, of in found.items() for k, (cost, path) in enumerate(sorted(of)[:4])}
    got = [(r.b, r["rank"], r.path, r.cost) for r in catalog.QUERIES["k_paths"](spark, TABLES).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({b for b, *_ in got}) > len(parts) // 2


@pytest.mark.parametrize("name", ["checked_names", "tool_answers"])
def test_every_event_is_a_call(spark, con, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, TABLES).toPandas()
    assert sorted(got["call_id"]) == sorted(r.event_id for r in tables.read(spark, TABLES, "events").collect())
    assert rows(got) == rows(con.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", ["lca", "common_ancestors", "one_sided_ancestors", "gen_f_pairs"])
def test_pairs_of_every_customer(spark, con, name):  # noqa: F811
    n = tables.read(spark, TABLES, "customer").count()
    got = catalog.QUERIES[name](spark, TABLES).toPandas()
    # the pair whose second number is 0 names no customer; common_ancestors leaves out pairs that share only the root
    assert graph.pairs(spark, TABLES).count() == n and len(got) > n / 5
    assert rows(got) == rows(con.sql(catalog.ORACLE[name]).df())


def test_keys_of_every_result(spark, con):  # noqa: F811
    got = catalog.QUERIES["keys_and_stamps"](spark, TABLES).toPandas()
    assert len(got) == tables.read(spark, TABLES, "lineitem").count()
    assert rows(got) == rows(con.sql(catalog.ORACLE["keys_and_stamps"]).df())


@pytest.mark.parametrize("repeated", ["customer", "region"])
def test_distances_where_names_repeat(spark, tmp_path, repeated):
    """Copies of the rows under shifted keys: a pair of names is one row, at the least of its sums."""
    c = duckdb.connect()
    key = f"{repeated[0]}_{'custkey' if repeated == 'customer' else 'regionkey'}"
    for t in ("region", "nation", "customer"):
        times = f"SELECT x.* REPLACE (CAST(x.{key} + i * (SELECT count(*) + 1 FROM '{TABLES}/{t}.parquet') AS {'BIGINT' if t == 'customer' else 'INTEGER'}) AS {key}) FROM '{TABLES}/{t}.parquet' x, range(3) r(i)"
        c.sql(f"COPY ({times if t == repeated else f"FROM '{TABLES}/{t}.parquet'"}) TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES["directed_distance"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(catalog.ORACLE["directed_distance"]).df())
