"""Queries of prompts, displays, messages, judging and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..operators import judging, ordering, replay
from ..operators.hierarchy import Hierarchy
from ..sources import tables
from .graph import tree
from .registry import query

_KIND = "CASE WHEN pos % 4 = 0 THEN 'multi' ELSE 'single' END"
_LINES = "'(A) ' || oa || chr(10) || '(B) ' || ob || chr(10) || '(C) ' || oc"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return tables.questions(spark, d).withColumn("kind", F.when(F.col("pos") % 4 == 0, "multi").otherwise("single"))


@query(
    f"""SELECT id, 'Be brief.' || CASE WHEN pos % 2 = 0 THEN chr(10) || 'Traversal calls are limited.' ELSE '' END AS system, text || chr(10) || chr(10) || {_LINES} || chr(10) || chr(10) ||
    CASE WHEN {_KIND} = 'multi' THEN 'End with: I select (X, Y). Choose all that apply of A, B, C, or NONE.' ELSE 'End with: I select (X). X is A, B, or C.' END AS user_text FROM questions""",
    "questions",
)
def question_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages that a question becomes."""
    q = _questions(spark, d)
    m = prompts.messages_of(F.lit("Be brief.\n "), F.col("text"), F.col("options"), F.col("kind"), F.col("pos") % 2 == 0)
    return q.select("id", m.alias("m")).select("id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user_text"))


@query(f"SELECT id, CASE WHEN correct = 'D' THEN CASE WHEN {_KIND} = 'multi' THEN '(D) UNKNOWN' ELSE 'UNKNOWN' END ELSE CASE WHEN {_KIND} = 'multi' THEN '(' || correct || ') ' ELSE '' END || CASE correct WHEN 'A' THEN oa ELSE ob END END AS correct_text FROM questions", "questions")
def question_display(spark: SparkSession, d: str) -> DataFrame:
    """P02."""
    return _questions(spark, d).select("id", prompts.correct_text(F.col("options"), F.col("correct"), F.col("kind")).alias("correct_text"))


@query(
    """SELECT id, '## Question' || chr(10) || text || chr(10) || chr(10) || '## Response to Evaluate' || chr(10) || CASE WHEN pos % 3 = 0 THEN '(no response)' ELSE oa END || chr(10) || chr(10) ||
    CASE WHEN pos % 2 = 0 THEN '## What to Evaluate' || chr(10) || ob || chr(10) || chr(10) ELSE '' END || '## Scoring Rubric (0–5)' || chr(10) || '[10] top' || chr(10) || '[5] good' || chr(10) || '[0] bad' || chr(10) || '[n/a] none' || chr(10) || chr(10) || 'End with a line: Score: N, with N from 0 to 5.' AS prompt FROM questions""",
    "questions",
)
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """P09, TX28: scores of the rubric fall, keys that are no numbers come last."""
    rubric = F.create_map(*(F.lit(x) for kv in {"0": "bad", "10": "top", "n/a": "none", "5": "good"}.items() for x in kv))
    p = prompts.judge_prompt(F.col("text"), F.when(F.col("pos") % 3 != 0, F.col("options")["A"]), F.when(F.col("pos") % 2 == 0, F.col("options")["B"]), rubric, F.lit(""))
    return tables.questions(spark, d).select("id", p.alias("prompt"))


@query("""SELECT conv_id AS conversation, turn, '{"role":"' || role || '","content":"' || length(text) || '"' || CASE WHEN turn % 2 = 0 THEN ',"name":"n"' ELSE '' END || '}' AS json, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN NULL ELSE CAST(length(text) AS VARCHAR) END AS api FROM conversations""")
def message_forms(spark: SparkSession, d: str) -> DataFrame:
    """P04, P05."""
    m = tables.messages(spark, d)
    short = F.char_length("content").cast("string")
    js = prompts.message_json(F.col("role"), short, F.when(F.col("turn") % 2 == 0, "n").otherwise(""), F.lit(None).cast("string"))
    api = prompts.api_content(F.col("role"), F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "").otherwise(short), F.lit(1))
    return m.select("conversation", "turn", js.alias("json"), api.alias("api"))


_JUDGED = """, r AS (SELECT CAST(event_id AS VARCHAR) AS question_id, event_id % 4 = 0 AS seen, CASE WHEN event_id % 9 = 0 THEN 'no_question' END AS status, CASE WHEN event_id % 5 = 0 THEN ' ' || chr(10) ELSE 'words' END AS response FROM events)"""


@query(_JUDGED + " SELECT question_id, CASE WHEN seen OR status IS NOT NULL OR response <> 'words' THEN 'skipped' WHEN question_id NOT IN (SELECT id FROM questions WHERE pos % 2 = 0) THEN 'no_question' ELSE 'judge' END AS action FROM r", "questions")
def judge_actions(spark: SparkSession, d: str) -> DataFrame:
    """What a judge still has to see."""
    e = F.col("event_id")
    r = tables.read(spark, d, "events").select(
        e.cast("string").alias("question_id"), F.when(e % 4 == 0, F.create_map(F.lit("j"), F.lit(None).cast("int"))).otherwise(F.create_map(F.lit("other"), F.lit(3))).alias("judge_scores"),
        F.when(e % 9 == 0, "no_question").alias("status"), F.when(e % 5 == 0, " \n").otherwise("words").alias("response"),
    )
    return judging.to_judge(r, tables.questions(spark, d).where("pos % 2 = 0"), "j").select("question_id", "action")


@query("SELECT CAST(doc_id AS VARCHAR) AS question_id, CASE WHEN doc_id % 2 = 0 THEN 4 WHEN doc_id % 7 <> 0 THEN quality * 5 END AS j1, CASE WHEN doc_id % 5 <> 0 THEN toxic * 5 END AS j2 FROM labels")
def judge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A judge's scores put into the maps of the panel."""
    panel = tables.judge_scores(spark, d).withColumnRenamed("scores", "judge_scores")
    new = panel.where("cast(question_id as long) % 2 = 0").select("question_id", F.lit(4).alias("score"))
    return judging.with_score(panel, new, "j1").select("question_id", F.col("judge_scores")["j1"].alias("j1"), F.col("judge_scores")["j2"].alias("j2"))


_CATS = ", c AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'third' END AS category, upper(s_name) AS descriptor, s_suppkey % 2 AS ord FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 UNION ALL SELECT 'late', s_name, 9 FROM supplier WHERE s_suppkey % 5 = 0)"


def _categories(spark: SparkSession, d: str) -> DataFrame:
    s, k = tables.read(spark, d, "supplier"), F.col("s_suppkey")
    a = s.where((k % 2 == 0) | (k % 3 == 0)).select(F.when(k % 2 == 0, "even").otherwise("third").alias("category"), F.upper("s_name").alias("descriptor"), (k % 2).cast("int").alias("ord"))
    return a.unionByName(s.where(k % 5 == 0).select(F.lit("late").alias("category"), F.col("s_name").alias("descriptor"), F.lit(9).alias("ord")))


@query(_CATS.replace(", c AS", "WITH c AS", 1) + " SELECT s_name AS name, coalesce((SELECT arg_min(category, (ord, category)) FROM c WHERE lower(descriptor) = lower(s_name)), 'unknown') AS category FROM supplier")
def category_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first category that lists a name, in any case."""
    return judging.category_of(tables.read(spark, d, "supplier").select(F.col("s_name").alias("name")), _categories(spark, d)).select("name", "category")


@query(_CATS.replace(", c AS", "WITH c AS", 1) + " SELECT DISTINCT descriptor FROM c")
def category_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """P11."""
    return judging.all_descriptors(_categories(spark, d))


@query("SELECT p, md5(string_agg(k, ',' ORDER BY k)) AS kids FROM (SELECT source AS p, target AS k FROM tree) GROUP BY p", "tree")
def flattened_edges(spark: SparkSession, d: str) -> DataFrame:
    """A map of lists of edges as rows."""
    from ..sources.files import flattened

    e = tree(spark, d).edges
    m = e.groupBy("source").agg(F.collect_list(F.struct("target", "path_type")).alias("es")).select(F.create_map("source", "es").alias("m"))
    return flattened(m).groupBy(F.col("source").alias("p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("target")), ",")).alias("kids"))


@query("SELECT c.name, CASE WHEN c.ancestor = 'NATION_9' THEN 'other' ELSE c.ancestor END || ' > ' || c.name AS path FROM tree_chain c WHERE c.dist = 1 AND c.ancestor LIKE 'NATION%'", "tree_chain")
def displayed_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path without the root, one category by its display name."""
    p = tree(spark, d).first_parent().where("parent like 'NATION%'")
    path = F.array(F.lit(tables.ROOT), F.when(F.col("parent") == "NATION_9", "defected").otherwise(F.col("parent")), F.col("name"))
    return p.select("name", text.display_path(path, tables.ROOT).alias("path"))


@query(
    """, l AS (SELECT name FROM tree_nodes WHERE name NOT IN (SELECT source FROM tree)), u AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, count(*) AS n FROM orders GROUP BY 1)
    SELECT name FROM l WHERE name NOT LIKE '%7' AND name NOT IN (SELECT name FROM u WHERE n >= 12) ORDER BY md5(concat_ws('|', 'k', name)), name LIMIT 25""",
    "tree_nodes",
)
def sampled_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves by hash, without excluded and overused ones."""
    h = tree(spark, d)
    used = tables.read(spark, d, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return judging.sample(h.leaves(), 25, "k", [h.nodes.where("name like '%7'")], used, 12)


@query(
    """, e AS (SELECT 'NATION_' || n_nationkey AS target, r_name AS name, (n_nationkey * 7 + r_regionkey * 3) % 8 AS distance FROM nation, region),
    o AS (SELECT target, distance, arg_min(name, (md5(concat_ws('|', 's', target, name)), name)) AS name FROM e GROUP BY ALL),
    w(target, name, distance, k) AS (SELECT target, name, distance, 1 FROM o WHERE distance = (SELECT min(distance) FROM o x WHERE x.target = o.target)
      UNION ALL SELECT o.target, o.name, o.distance, w.k + 1 FROM w JOIN o ON o.target = w.target AND w.k < 3 AND o.distance = (SELECT min(x.distance) FROM o x WHERE x.target = w.target AND x.distance >= w.distance + 2))
    SELECT target, name, distance FROM w""".replace(", e AS", "WITH RECURSIVE e AS", 1)
)
def spaced_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One candidate for each distance, at least two apart, nearest first."""
    r, n = tables.read(spark, d, "region"), tables.read(spark, d, "nation")
    e = n.crossJoin(F.broadcast(r)).select(F.concat(F.lit("NATION_"), "n_nationkey").alias("target"), F.col("r_name").alias("name"), ((F.col("n_nationkey") * 7 + F.col("r_regionkey") * 3) % 8).alias("distance"))  # fixed tables of 25 and 5 rows
    return ordering.spaced_levels(e, 3, 2, "s")


@query(
    "SELECT user_id AS response_id, string_agg(event_type, '' ORDER BY ts, event_id) FILTER (WHERE event_id % 10 <> 0) AS content, CAST(arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 10 <> 0 AND event_id % 4 = 0) AS BIGINT) AS input_tokens FROM events GROUP BY user_id"
)
def assembled_streams(spark: SparkSession, d: str) -> DataFrame:
    """Server-sent lines put together; broken ones are passed over."""
    e = F.col("event_id")
    good = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit('"}}]'), F.when(e % 4 == 0, F.concat(F.lit(',"usage":{"prompt_tokens":'), e, F.lit(',"completion_tokens":1}'))).otherwise(""), F.lit("}"))
    lines = tables.read(spark, d, "events").select(F.col("user_id").alias("response_id"), F.struct("ts", "event_id").alias("seq"), F.when(e % 10 == 0, "data: {broken").otherwise(good).alias("line"))
    return replay.assembled(lines).select("response_id", "content", "input_tokens")


@query("SELECT user_id AS conversation, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS model FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type <> 'error') > 0")
def first_resolved(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    e = tables.read(spark, d, "events").select(F.col("user_id").alias("conversation"), F.struct("ts", "event_id").alias("turn"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("resolved_model"))
    return replay.first_resolved(e)


@query("SELECT r.model, count(*) AS n FROM (SELECT 'm' || (user_id % 5) AS model, user_id, count(*) AS k FROM events WHERE event_type = 'view' GROUP BY ALL HAVING count(*) >= 3) r GROUP BY r.model ORDER BY n DESC, r.model LIMIT 4")
def loops_by_model(spark: SparkSession, d: str) -> DataFrame:
    """A21, O04, TX25: models with the most repeating conversations."""
    e = tables.read(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("k")).where("k >= 3")
    model = text.short_model(F.concat(F.lit("x/y/m"), F.col("user_id") % 5))
    return e.groupBy(model.alias("model")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(4)


@query("SELECT question_id, model, condition, score FROM results WHERE question_id = '5' QUALIFY row_number() OVER (ORDER BY pos, task_type, model) = 1", "results")
def result_lookup(spark: SparkSession, d: str) -> DataFrame:
    """UD9: one result by its id, the first if there are several."""
    r = tables.results(spark, d).where("question_id = '5'")
    return r.orderBy("pos", "task_type", "model").limit(1).select("question_id", "model", "condition", "score")


@query("SELECT question_id, concat_ws('/', model, condition, question_id) AS cache_key, concat_ws('_', model, condition) AS summary_key, strftime(mtime, '%Y%m%d_%H%M%S') AS stamp, CAST(mtime AS DATE) = DATE '1998-05-01' AS same_day FROM results", "results")
def keys_and_stamps(spark: SparkSession, d: str) -> DataFrame:
    """TX26, TX27, DT03, DT04."""
    r = tables.results(spark, d)
    return r.select("question_id", F.concat_ws("/", "model", "condition", "question_id").alias("cache_key"), F.concat_ws("_", "model", "condition").alias("summary_key"), F.date_format("mtime", "yyyyMMdd_HHmmss").alias("stamp"), (F.to_date("mtime") == F.lit("1998-05-01").cast("date")).alias("same_day"))


@query(
    """SELECT * FROM (VALUES ('root', 0::BIGINT, false, 0, NULL, 0::BIGINT), ('floral', 1, false, 1, 'root', 1), ('fruity', 2, false, 1, 'root', 1), ('rose', 3, true, 2, 'floral', 0), ('berry', 4, true, 2, 'fruity', 0))
    t(name, ord, is_leaf, depth, parent, n_siblings)"""
)
def wheel_facts(spark: SparkSession, d: str) -> DataFrame:
    """A small hierarchy from rows; files are read in the tests."""
    from ..sources.files import graph_from_rows

    h: Hierarchy = graph_from_rows(spark, ["root", "floral", "fruity", "rose", "berry"], [{"source": a, "target": b} for a, b in (("root", "floral"), ("root", "fruity"), ("floral", "rose"), ("fruity", "berry"))], "root")
    return h.facts()
