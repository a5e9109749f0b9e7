"""Queries over results as they are stored: rounding, public fields, summaries of cache documents, arrivals in batches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import without_internal
from ..functions.rounding import rounded
from ..operators import generate, summary
from ..sources import bank, tables
from ..sources import ledger as ledger_files
from ..sources.commits import Commits
from ..sources.ledger import open_ledger
from ..steps import folder
from ..streaming import increments
from .registry import query

_HALVES = "(l_partkey % 100000 + 0.5::DOUBLE) / 10000.0::DOUBLE"


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS a, {_HALVES} AS b, (l_orderkey % 4096)::DOUBLE / 4096.0::DOUBLE - l_discount AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(printf('%.4f', a) AS DOUBLE) AS a4, CAST(printf('%.2f', a) AS DOUBLE) AS a2, CAST(printf('%.4f', b) AS DOUBLE) AS b4, CAST(printf('%.2f', b) AS DOUBLE) AS b2,
      CAST(printf('%.4f', c) AS DOUBLE) + 0.0 AS c4, CAST(printf('%.2f', c) AS DOUBLE) + 0.0 AS c2 FROM x"""
)
def exact_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Prices, halves that no double holds, and dyadic fractions, to 4 and 2 places by their exact values, half to even."""
    c = F.col
    x = tables.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_extendedprice") / c("l_quantity")).alias("a"), ((c("l_partkey") % 100000 + F.lit(0.5)) / F.lit(10000.0)).alias("b"),
        ((c("l_orderkey") % 4096).cast("double") / F.lit(4096.0) - c("l_discount")).alias("c"),
    )
    return x.select("l_orderkey", "l_linenumber", *((rounded(n, p) + F.lit(0.0)).alias(f"{n}{p}") for n in "abc" for p in (4, 2)))


@query("""SELECT event_id, '{"kind":"' || event_type || '","detail":{"value":' || CAST(floor(value) AS BIGINT) || ',"tags":[{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '},{"k":' || (event_id % 7) || '}]},"scores":{"j1":' || (event_id % 6) || '}}' AS doc FROM events""")
def public_results(spark: SparkSession, d: str) -> DataFrame:
    """Nested results without their internal fields, at any depth."""
    c = F.col
    tag = lambda k: F.struct(k.alias("k"), F.lit("x").alias("_raw"))
    detail = F.struct(F.floor("value").cast("long").alias("value"), F.lit(1).alias("_rank"), F.array(tag(F.get_json_object("props", "$.k").cast("int")), tag((c("event_id") % 7).cast("int"))).alias("tags"), F.struct(F.lit(1).alias("_a")).alias("_inner"))
    whole = F.struct(c("event_type").alias("kind"), F.lit(0.5).alias("_score"), detail.alias("detail"), F.create_map(F.lit("j1"), c("event_id") % 6, F.lit("_mean"), c("event_id") % 5).alias("scores"))
    rows = tables.read(spark, d, "events").select("event_id", c("event_id").alias("_pos"), whole.alias("doc"))
    return without_internal(rows).select("event_id", F.to_json("doc").alias("doc"))


_CACHE = """, c AS (SELECT question_id, CASE WHEN pos % 50 = 3 THEN NULL ELSE model END AS model, condition, CASE WHEN pos % 40 = 1 THEN NULL ELSE task_type END AS task_type, is_correct, CASE WHEN pos % 3 = 0 THEN score END AS given,
      CASE WHEN pos % 30 = 2 THEN NULL ELSE total_tokens END AS total_tokens, latency_ms,
      CASE WHEN pos % 2 = 0 THEN [CASE WHEN pos % 4 <> 0 THEN pos % 6 END, CASE WHEN pos % 14 <> 0 THEN (pos + 1) % 6 END, CASE WHEN pos % 28 <> 4 THEN total_tokens % 6 END] END AS js FROM results),
    j AS (SELECT *, list_avg(js)::DOUBLE AS judge FROM c),
    r AS (SELECT coalesce(model, 'unknown') AS model, condition, coalesce(task_type, '') AS task_type, is_correct, coalesce(judge / 5, given, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS score, judge, coalesce(total_tokens, 0) AS tokens, latency_ms FROM j),
    g AS (SELECT model, condition, task_type, grouping(model, condition, task_type) AS grouping, count(*) AS n, avg(is_correct::INT) AS accuracy, avg(score) AS avg_score, avg(judge) AS avg_judge, count(judge) AS n_judged, avg(tokens) AS avg_tokens, avg(latency_ms) AS avg_latency
      FROM r GROUP BY GROUPING SETS ((model, condition), (model), (condition), (task_type), ())),
    t AS (SELECT model, condition, task_type, grouping(model, condition) AS g, avg(score) AS m FROM r WHERE task_type <> '' GROUP BY GROUPING SETS ((model, condition, task_type), (model, task_type), (condition, task_type), (task_type))),
    m AS (SELECT model, condition, g * 2 + 1 AS grouping, avg(m) AS macro FROM t GROUP BY ALL)
    SELECT g.model, g.condition, g.task_type, CAST(g.grouping AS INTEGER) AS grouping, g.n, g.n_judged, round(accuracy, 6) AS accuracy, round(avg_score, 6) AS avg_score, round(avg_judge, 6) AS avg_judge_score, round(CASE WHEN g.grouping <> 6 THEN coalesce(macro, 0) END, 6) AS macro_score,
      round(CASE WHEN g.grouping IN (1, 7) THEN avg_tokens END, 6) AS avg_tokens, round(CASE WHEN g.grouping IN (1, 7) THEN avg_latency END, 6) AS avg_latency_ms
    FROM g LEFT JOIN m ON m.grouping = g.grouping AND m.model IS NOT DISTINCT FROM g.model AND m.condition IS NOT DISTINCT FROM g.condition WHERE g.grouping <> 6 OR g.task_type <> ''"""


def cache_documents(spark: SparkSession, d: str) -> DataFrame:
    """Cache documents of the results: some without model, task type or tokens, half of them with a panel's scores."""
    c, r = F.col, tables.results(spark, d)
    pos = c("pos")
    scores = F.create_map(F.lit("j1"), F.when(pos % 4 != 0, pos % 6), F.lit("j2"), F.when(pos % 14 != 0, (pos + 1) % 6), F.lit("j3"), F.when(pos % 28 != 4, c("total_tokens") % 6))
    return r.select(
        "question_id", F.when(pos % 50 != 3, c("model")).alias("model"), "condition", F.when(pos % 40 != 1, c("task_type")).alias("task_type"), "is_correct", F.when(pos % 3 == 0, c("score")).alias("score"),
        F.when(pos % 2 == 0, scores).alias("judge_scores"), F.when(pos % 30 != 2, c("total_tokens")).alias("total_tokens"), "latency_ms",
    )


@query(_CACHE, "results")
def cache_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of cache documents, scored by their panels, over all groupings."""
    got = summary.of_cache(cache_documents(spark, d))
    doubles = [n for n, t in got.dtypes if t == "double"]
    return got.withColumns({n: F.round(n, 6) for n in doubles})

# --- arrivals in batches -----------------------------------------------------------------------------------------------

_LATEST = """, l AS (SELECT *, row_number() OVER (PARTITION BY question_id, model, condition ORDER BY mtime DESC, pos DESC, task_type DESC, score DESC, is_correct DESC, judge_score DESC NULLS LAST, total_tokens DESC, latency_ms DESC) AS rn FROM results),
    r AS (SELECT * FROM l WHERE rn = 1)"""
_SUMMARY = """, g AS (SELECT model, condition, task_type, grouping(model, condition, task_type) AS grouping, count(*) AS n, avg(is_correct::INT) AS accuracy, avg(score) AS avg_score, avg(judge_score) AS avg_judge, avg(total_tokens) AS avg_tokens, avg(latency_ms) AS avg_latency
      FROM r GROUP BY GROUPING SETS ((model, condition), (model), (condition), (task_type), ())),
    t AS (SELECT model, condition, task_type, grouping(model, condition) AS g, avg(score) AS m FROM r GROUP BY GROUPING SETS ((model, condition, task_type), (model, task_type), (condition, task_type), (task_type))),
    m AS (SELECT model, condition, g * 2 + 1 AS grouping, avg(m) AS macro FROM t GROUP BY ALL)
    SELECT g.model, g.condition, g.task_type, CAST(g.grouping AS INTEGER) AS grouping, g.n, round(accuracy, 6) AS accuracy, round(avg_score, 6) AS avg_score, round(avg_judge, 6) AS avg_judge_score, round(CASE WHEN g.grouping <> 6 THEN macro END, 6) AS macro_score,
      round(CASE WHEN g.grouping IN (1, 7) THEN avg_tokens END, 6) AS avg_tokens, round(CASE WHEN g.grouping IN (1, 7) THEN avg_latency END, 6) AS avg_latency_ms
    FROM g LEFT JOIN m ON m.grouping = g.grouping AND m.model IS NOT DISTINCT FROM g.model AND m.condition IS NOT DISTINCT FROM g.condition"""


def _in_batches(rows: DataFrame, many: int, *by: str) -> str:
    """Writes the rows as so many files, dealt by hash, and gives their folder."""
    at = f"{folder(rows.sparkSession)}/in"
    rows.withColumn("_b", F.pmod(F.xxhash64(*by), F.lit(many))).repartition(many, "_b").write.partitionBy("_b").parquet(at)
    return at


@query(_LATEST + _SUMMARY, "results")
def incremental_summary(spark: SparkSession, d: str) -> DataFrame:
    """Results arrive in three batches in any order; each adds its changes to partial sums, of which the summary is made."""
    rows = tables.results(spark, d).select(*(F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in increments.ROW.split(", ")))
    at, top = folder(spark), folder(spark)
    partials = Commits(spark, f"{top}/partials", increments.PARTIALS)
    for k in range(3):  # each run of the stream goes on where the last ended
        rows.where(F.pmod(F.xxhash64("question_id", "model", "pos"), F.lit(3)) == k).write.parquet(f"{at}/{k}")
        arrive = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(at)
        increments.keep_partials(arrive, partials, f"{top}/checkpoint").awaitTermination()
    got = increments.summary_of(partials.read())
    return got.withColumns({n: F.round(n, 6) for n, t in got.dtypes if t == "double"})


@query("SELECT question_id, model, condition, max(mtime) AS mtime, max(pos) AS pos FROM (SELECT *, rank() OVER (PARTITION BY question_id, model, condition ORDER BY mtime DESC) AS rk FROM results) WHERE rk = 1 GROUP BY ALL", "results")
def committed_results(spark: SparkSession, d: str) -> DataFrame:
    """Results committed in four parts by two writers whose commits meet, and read as one table, one row for each key."""
    rows = tables.results(spark, d).select("question_id", "model", "condition", "mtime", "pos")
    schema = "question_id string, model string, condition string, mtime timestamp, pos long"
    path = f"{folder(spark)}/results"
    last = rows.groupBy("question_id", "model", "condition").agg(F.max(F.struct("mtime", "pos")).alias("x")).select("question_id", "model", "condition", "x.mtime", "x.pos")
    one, two = (Commits(spark, path, schema, ["question_id", "model", "condition"]) for _ in range(2))
    one.add(rows, {"run_status": "running"})
    with ThreadPoolExecutor(2) as both:  # the two meet at the same version
        list(both.map(lambda w: w[0].add(last.where(F.pmod(F.xxhash64("question_id"), F.lit(2)) == w[1])), ((one, 0), (two, 1))))
    one.update(lambda df: df, {"run_status": "complete"})
    return two.read()


@query(
    """, w AS (SELECT question_id, model, condition, l.pos, ROW_NUMBER() OVER (PARTITION BY question_id, model, condition ORDER BY pos DESC) AS rn FROM results l)
    SELECT question_id, model, condition, max(pos) AS pos, 6::BIGINT AS files_first, 2::BIGINT AS files_then, 0::BIGINT AS files_last FROM w GROUP BY question_id, model, condition""",
    "results",
)
def ledgered_results(spark: SparkSession, d: str) -> DataFrame:
    """Result files read as they come, by a ledger: six files, then the two new ones, then none; the row of the highest position counts."""
    rows = tables.results(spark, d).select("question_id", "model", "condition", "pos")
    top = folder(spark)
    ledger, target = open_ledger(spark, f"{top}/ledger"), Commits(spark, f"{top}/merged", "question_id string, model string, condition string, pos long, _path string, _mtime timestamp")
    part = F.pmod(F.xxhash64("question_id", "model", "pos"), F.lit(8))
    read = lambda reader, paths: reader.schema("question_id string, model string, condition string, pos long").json(paths)
    many = []
    for lo, hi in ((0, 6), (6, 8), (8, 8)):
        for k in range(lo, hi):  # a file each
            rows.where(part == k).coalesce(1).write.json(f"{top}/in/{k}")
        many.append(ledger_files.refresh(spark, f"{top}/in", ledger, target, read, "part-*.json"))
    got = target.read().groupBy("question_id", "model", "condition").agg(F.max("pos").alias("pos"))
    return got.withColumns({n: F.lit(m).cast("long") for n, m in zip(("files_first", "files_then", "files_last"), many, strict=True)})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 300 AS d FROM orders")
def questions_appended_once(spark: SparkSession, d: str) -> DataFrame:
    """Questions that arrive in three batches, a third of them twice, are appended once each."""
    q = tables.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 300).alias("d"))
    twice = q.withColumn("turn", F.lit(0)).unionByName(q.where("d % 3 = 0").withColumn("turn", F.lit(1)))
    at, top = _in_batches(twice, 3, "id", "turn"), folder(spark)
    bank = Commits(spark, f"{top}/bank", "id string, d long")
    with increments.state_store(spark):
        arrive = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)
        increments.append_new(arrive.select("id", "d"), bank, f"{top}/checkpoint").awaitTermination()
    return bank.read()


# --- the question bank as a whole --------------------------------------------------------------------------------------

_TYPED = """WITH q AS (SELECT ['A1_root', 'A2_ancestor', 'E1_rank', NULL][CAST(o_orderkey % 4 AS INTEGER) + 1] AS task_type, ['A1_', 'A2_', 'e1_', 'F_'][CAST(o_orderkey % 4 AS INTEGER) + 1] || o_orderkey AS id,
      CASE WHEN o_custkey % 9 <> 0 THEN ['A', 'A', 'E', 'F'][CAST(o_orderkey % 4 AS INTEGER) + 1] END AS category, o_orderstatus AS st FROM orders)"""


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions (id, task_type, category) and their state (question_id, status), of the orders."""
    c = F.col
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (c("o_orderkey") % 4 + 1).cast("int"))
    o = tables.read(spark, d, "orders").select(
        pick("A1_root", "A2_ancestor", "E1_rank", None).alias("task_type"), F.concat(pick("A1_", "A2_", "e1_", "F_"), c("o_orderkey").cast("string")).alias("id"), F.when(c("o_custkey") % 9 != 0, pick("A", "A", "E", "F")).alias("category"), "o_orderstatus"
    )
    state = o.where("o_orderstatus <> 'O'").select(F.col("id").alias("question_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("flagged").alias("status"))
    return o.drop("o_orderstatus"), state.unionByName(spark.createDataFrame([("gone", "confirmed")], "question_id string, status string"))


@query(
    _TYPED + """ SELECT 'total' AS what, '' AS key, count(*) AS n FROM q UNION ALL SELECT 'category', coalesce(category, ''), count(*) FROM q GROUP BY ALL
    UNION ALL SELECT 'task_type', coalesce(task_type, ''), count(*) FROM q GROUP BY ALL UNION ALL SELECT 'confirmed', upper(string_split(coalesce(task_type, id), '_')[1]), count(*) FROM q WHERE st = 'F' GROUP BY ALL"""
)
def bank_counts(spark: SparkSession, d: str) -> DataFrame:
    """What is counted when a bank is saved, read back from its commit."""
    q, state = _typed(spark, d)
    into = Commits(spark, f"{folder(spark)}/bank", "id string, task_type string, category string")
    bank.save(q, into, state)
    meta = into.log()[-1]["meta"]
    saved = [(*k.split(":", 1), int(v)) for k, v in meta.items() if ":" in k and k != "last_modified"]
    return spark.createDataFrame(saved, "what string, key string, n long")


@query(_TYPED + " SELECT id, task_type FROM q WHERE (starts_with(task_type, 'A') OR starts_with(id, 'A')) AND st = 'F'")
def confirmed_of_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The confirmed questions whose task type or id begins with A."""
    q, state = _typed(spark, d)
    return bank.some_questions(q, "A", state).select("id", "task_type")


_NOTE = "chr(10) || chr(10) || '*''other'' includes non-standard or less common flavor categories'"


@query(
    f"""WITH q AS (SELECT o_orderkey AS id, ['A1_root', 'E1', 'E2', 'E3_odd', 'A2'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS task_type, CASE WHEN o_custkey % 4 = 0 THEN 'defected' ELSE 'd' || (o_custkey % 30) END AS name,
      CASE WHEN o_custkey % 3 = 0 THEN 'defected' ELSE 'o' || (o_custkey % 7) END AS one FROM orders),
    s AS (SELECT *, CASE WHEN one = 'defected' THEN 'other' ELSE one END AS shown, CASE WHEN name = 'defected' AND task_type IN ('E1', 'E2') THEN 'other' ELSE name END AS target FROM q)
    SELECT id, task_type, 'Like ''' || target || '''?' || CASE WHEN task_type <> 'A2' AND (shown = 'other' OR target = 'other') THEN {_NOTE} ELSE '' END AS text,
      CASE WHEN task_type = 'E1' THEN 'a > ' || shown || '|' || shown || ' > a' ELSE shown || '|mother' END AS options FROM s"""
)
def displayed_questions(spark: SparkSession, d: str) -> DataFrame:
    """TX21, P13: questions as they are shown, with a footnote where an option, a ranked node or the target is shown as other."""
    c = F.col
    one = F.when(c("o_custkey") % 3 == 0, "defected").otherwise(F.concat(F.lit("o"), c("o_custkey") % 7))
    name = F.when(c("o_custkey") % 4 == 0, "defected").otherwise(F.concat(F.lit("d"), c("o_custkey") % 30))
    task = F.element_at(F.array(*(F.lit(t) for t in ("A1_root", "E1", "E2", "E3_odd", "A2"))), (c("o_orderkey") % 5 + 1).cast("int"))
    options = F.when(task == "E1", F.array(F.concat(F.lit("a > "), one), F.concat(one, F.lit(" > a")))).otherwise(F.array(one, F.lit("mother")))
    q = tables.read(spark, d, "orders").select(c("o_orderkey").alias("id"), task.alias("task_type"), name.alias("name"), F.concat(F.lit("Like '"), name, F.lit("'?")).alias("text"), options.alias("options"))
    return generate.displayed(q).select("id", "task_type", "text", F.array_join("options", "|").alias("options"))
