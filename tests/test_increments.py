"""Summaries by increments and files by ledger, against all rows at once."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from trellis.functions.nested import without_internal
from trellis.functions.rounding import rounded
from trellis.operators import summary
from trellis.operators.ordering import last_writer_wins
from trellis.sources import ledger as ledger_files
from trellis.sources.commits import Commits
from trellis.streaming import increments

SUMMARY = ["grouping", "model", "condition", "task_type", "n", "accuracy", "avg_score", "macro_score", "avg_judge_score", "avg_tokens", "avg_latency_ms"]


def made(n, seed):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    return [
        (f"q{rng.randint(0, 12)}", rng.choice(["m1", "m2"]), rng.choice(["tool", "no_tool"]), rng.choice(["T1", "T2", "T3"]), day + datetime.timedelta(hours=rng.randint(0, 40)), i,
         rng.choice([0.1, 0.7, 1 / 3, None]), rng.choice([True, False]), rng.choice([None, 3.0, 5.0]), rng.randint(0, 9), rng.choice([None, 100]))
        for i in range(n)
    ]


SCHEMA = "question_id string, model string, condition string, task_type string, mtime timestamp, pos long, score double, is_correct boolean, judge_score double, total_tokens long, latency_ms long"


def rounded_rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*SUMMARY).collect()), key=str)


@pytest.fixture
def store(spark):
    with increments.state_store(spark):
        yield


def test_batches_in_any_order(spark, tmp_path, store):
    rows = made(240, 1) + [(None, "m1", "tool", "T1", None, 1, 1.0, True, None, 1, 1), ("q1", None, "tool", "T1", None, 1, 1.0, True, None, 1, 1)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = rounded_rows(summary.summary(last_writer_wins(whole, ["question_id", "model", "condition"], "mtime", "pos")))
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        top = tmp_path / "".join(map(str, order))
        partials = Commits(spark, str(top / "partials"), increments.PARTIALS)
        for at, k in enumerate(order):
            spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.parquet(str(top / f"in/b{at}"))
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(top / "in"))
            increments.keep_partials(stream, partials, str(top / "checkpoint")).awaitTermination()  # each run goes on where the last ended
        assert rounded_rows(increments.summary_of(partials.read())) == want
        assert [c["meta"]["batch"] for c in partials.log()] == ["0", "1", "2", "3"]


def test_a_group_that_loses_its_last_row_goes(spark):
    change = spark.createDataFrame(
        [("m", "tool", "T1", 1, 0.1, True, None, 5, None), ("m", "tool", "T1", -1, 0.1, True, None, 5, None), ("m", "tool", "T2", 1, None, None, 4.0, None, 7)],
        "model string, condition string, task_type string, sign int, score double, is_correct boolean, judge_score double, total_tokens long, latency_ms long",
    )
    change = change.withColumns({c: F.col(c).cast("decimal(24,12)") for c in ("score", "judge_score")})
    none = spark.createDataFrame([], increments.PARTIALS)
    first = increments.merged(none, increments.partials_of(change.limit(1)))
    assert first.first().score_sum > 0
    both = increments.merged(first, increments.partials_of(change.where("sign < 0 or task_type = 'T2'"))).collect()
    assert [(r.task_type, r.n, r.known, r.score_n, r.judge_score_n, int(r.latency_ms_sum)) for r in both] == [("T2", 1, 0, 0, 1, 7)]
    assert increments.summary_of(none).where("n > 0").count() == 0


def test_a_batch_counts_once(spark, tmp_path):
    partials = Commits(spark, str(tmp_path / "p"), increments.PARTIALS)
    seen = lambda log: not any((c["meta"] or {}).get("batch") == "0" for c in log)
    assert partials.update(lambda df: df, {"batch": 0}, only_if=seen) == 1 and partials.update(lambda df: df, {"batch": 0}, only_if=seen) is None


def test_questions_are_appended_once(spark, tmp_path, store):
    bank = Commits(spark, str(tmp_path / "bank"), "id string, v long")
    for k, rows in enumerate([[("a", 1), ("b", 1), ("a", 2), (None, 3)], [("b", 4), ("c", 4)], [("a", 5)]]):
        spark.createDataFrame(rows, "id string, v long").coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
        stream = spark.readStream.schema("id string, v long").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        increments.append_new(stream, bank, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.id for r in bank.read().collect()) == ["a", "b", "c"] and {r.v for r in bank.read().where("id <> 'a'").collect()} == {1, 4}


@pytest.mark.parametrize("by_name", [10_000, 0])
def test_only_new_files_are_read(spark, tmp_path, monkeypatch, by_name):
    monkeypatch.setattr(ledger_files, "BY_NAME", by_name)
    top = tmp_path / "in"
    top.mkdir()

    def put(name, text, mtime):
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
        os.utime(top / name, (mtime, mtime))

    read = lambda reader, paths: reader.schema("k string, v long").json(paths)
    ledger, target = ledger_files.open_ledger(spark, str(tmp_path / "ledger")), Commits(spark, str(tmp_path / "rows"), "k string, v long, _path string, _mtime timestamp")
    go = lambda: ledger_files.refresh(spark, str(top), ledger, target, read)
    now = lambda: {r.k: r.v for r in ledger_files.merged(target, ["k"]).collect()}
    put("a.json", '{"k":"x","v":1}\n{"k":"y","v":1}', 1_000_000)
    put("sub/b.json", '{"k":"x","v":2}', 1_000_500)
    put("c.txt", '{"k":"x","v":9}', 1_000_900)
    assert go() == 2 and now() == {"x": 2, "y": 1}
    put("a.json", '{"k":"x","v":7}\n{"k":"y","v":7}', 1_000_000)  # other contents, but nothing says so: an old file is not read again
    put("d.json", '{"k":"z","v":3}', 999_000)  # new, though older than what has been read
    assert go() == 1 and now() == {"x": 2, "y": 1, "z": 3}
    assert go() == 0 and target.version() == 2
    put("a.json", '{"k":"x","v":10}\n{"k":"y","v":1}', 1_000_000)  # another size
    put("d.json", '{"k":"x","v":4}', 1_002_000)  # another time
    assert go() == 2 and now() == {"x": 4, "y": 1, "z": 3}


def test_a_run_that_dies_reads_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k":"x","v":1}')
    read = lambda reader, paths: reader.schema("k string, v long").json(paths)
    ledger, target = ledger_files.open_ledger(spark, str(tmp_path / "ledger")), Commits(spark, str(tmp_path / "rows"), "k string, v long, _path string, _mtime timestamp")
    with monkeypatch.context() as m:
        m.setattr(ledger, "add", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            ledger_files.refresh(spark, str(tmp_path / "in"), ledger, target, read)
    assert ledger_files.refresh(spark, str(tmp_path / "in"), ledger, target, read) == 1
    assert target.read().count() == 2 and [r.v for r in ledger_files.merged(target, ["k"]).collect()] == [1]


def test_rounding_is_pythons(spark):
    rng = random.Random(5)
    xs = [0.0, -0.0, 2.675, 0.5, 1.5, -2.5, 1e300, 5e-324, -1e-5, float("inf"), None, 0.00005, 2**52 + 0.5, 2**49 + 0.0625]
    xs += [rng.random() * 10 ** rng.randint(-8, 17) for _ in range(5000)] + [(i + 0.5) / 10**n for i in range(500) for n in range(5)] + [i / 2**k for i in range(300) for k in (1, 5, 12)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(rounded("x", n).alias(f"r{n}") for n in range(5))).collect()
    for r in got:
        for n in range(5):
            want = r.x if r.x is None or abs(r.x) == float("inf") else round(r.x, n)
            assert str(r[f"r{n}"]) == str(want), (r.x, n)
    odd = spark.createDataFrame([(float("nan"),)], "x double").select(rounded("x", 2).alias("r")).first().r
    assert odd != odd
    with pytest.raises(ValueError):
        rounded("x", 5)


def test_internal_fields_go(spark):
    schema = "id int, _pos int, a struct<x:int,_y:int,z:array<struct<p:int,_q:int>>,w:struct<_only:int>>, m map<string,struct<u:int,_v:int>>, n map<int,int>, _z string, `d.e` int, s struct<_1:int>, l array<array<struct<_k:int,k:int>>>"
    rows = [(1, 2, (3, 4, [(5, 6), None], (7,)), {"a": (8, 9), "_b": (1, 2), "c": None}, {1: 2}, "z", 10, (1,), [[(1, 2)], None]), (2, None, None, None, None, None, None, None, None), (3, None, (None, None, [], None), {}, {}, None, None, None, [])]
    got = without_internal(spark.createDataFrame(rows, schema))
    assert got.columns == ["id", "a", "m", "n", "d.e", "l"]
    one, two, three = (r.asDict(True) for r in got.orderBy("id").collect())
    assert one == {"id": 1, "a": {"x": 3, "z": [{"p": 5}, None], "w": None}, "m": {"a": {"u": 8}, "c": None}, "n": {1: 2}, "d.e": 10, "l": [[{"k": 2}], None]}
    assert two == {"id": 2, "a": None, "m": None, "n": None, "d.e": None, "l": None}
    assert three == {"id": 3, "a": {"x": None, "z": [], "w": None}, "m": {}, "n": {}, "d.e": None, "l": []}


def test_summary_of_cache_documents(spark):
    rows = [
        ("1", "m", "tool", "T1", True, None, {"a": 5, "b": None}, 10, 1), ("2", "m", "tool", "F", None, 0.4, {"a": None}, None, None), ("3", None, "tool", None, False, None, None, 30, 3), ("4", "m", "tool", "F", False, 0.9, {"a": 3, "b": 4}, 0, 0),
    ]
    df = spark.createDataFrame(rows, "question_id string, model string, condition string, task_type string, is_correct boolean, score double, judge_scores map<string,int>, total_tokens long, latency_ms long")
    got = {(r.grouping, r.model, r.condition, r.task_type): r for r in summary.of_cache(df).collect()}
    whole = got[7, None, None, None]
    assert whole.n == 4 and whole.n_judged == 2 and whole.accuracy == 0.25 and whole.avg_judge_score == (5 + 3.5) / 2 and abs(whole.avg_score - (1 + 0.4 + 0 + 0.7) / 4) < 1e-12
    assert abs(whole.macro_score - (1 + 0.55) / 2) < 1e-12 and whole.avg_tokens == 10 and whole.avg_latency_ms == 1
    assert (1, "unknown", "tool", None) in got and not [k for k in got if k[0] == 6 and not k[3]]
    assert summary.of_cache(df.limit(0)).where("n > 0").count() == 0


def test_a_batch_that_failed_between_its_commits_counts_once(spark, tmp_path):
    rows = made(90, 3)
    want = rounded_rows(summary.summary(last_writer_wins(spark.createDataFrame(rows, SCHEMA), ["question_id", "model", "condition"], "mtime", "pos")))
    partials = Commits(spark, str(tmp_path / "partials"), increments.PARTIALS)
    log = Commits(spark, str(tmp_path / "partials/_changes"), increments.LOG)
    for k in range(3):
        part = spark.createDataFrame(rows[k::3], SCHEMA)
        if k == 1:  # an earlier try wrote the log of this batch and died before the sums
            log.add(increments.later(increments.typed(part), log.read()).withColumn("batch", F.lit(k)), {"batch": k})
        part.coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        increments.keep_partials(stream, partials, str(tmp_path / "checkpoint")).awaitTermination()
    assert rounded_rows(increments.summary_of(partials.read())) == want
    assert [c["meta"]["batch"] for c in log.log()] == ["0", "1", "2"]


def test_ties_and_nulls_have_one_order(spark):
    day = datetime.datetime(2024, 1, 1)
    key = ("q", "m", "c")
    row = lambda *v: (*key, v[2], *v[:2], *v[3:])
    rows = [row(day, 1, "T1", 0.5, None, None, 1, None), row(day, 1, "T1", 0.5, False, None, 1, None), row(None, 9, "T9", 1.0, True, 5.0, 9, 9), row(day, 1, "T1", None, True, 5.0, 1, None)]
    for order in (rows, rows[::-1]):
        log = spark.createDataFrame([], increments.LOG)
        for k, r in enumerate(order):
            log = log.unionByName(increments.later(increments.typed(spark.createDataFrame([r], SCHEMA)), log).withColumn("batch", F.lit(k).cast("long")))
        sums = increments.merged(spark.createDataFrame([], increments.PARTIALS), increments.partials_of(increments.changes(log))).collect()
        assert [(r.task_type, r.n, r.known, r.correct, float(r.score_sum)) for r in sums] == [("T1", 1, 1, 0, 0.5)]
