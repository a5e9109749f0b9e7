"""Queries over evaluation results and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import ordering, summary
from ..sources import tables
from .registry import query

R6 = lambda c: F.round(c, 6).alias(c)


@query(
    """, t AS (SELECT model, condition, task_type, avg(score) AS m FROM results GROUP BY ALL), k AS (SELECT model, condition, avg(m) AS macro FROM t GROUP BY ALL)
    SELECT model, round(max(macro) FILTER (WHERE condition = 'no_tool'), 6) AS no_tool, round(max(macro) FILTER (WHERE condition = 'tool'), 6) AS tool,
    round(max(macro) FILTER (WHERE condition = 'tool') - max(macro) FILTER (WHERE condition = 'no_tool'), 6) AS delta FROM k GROUP BY model""",
    "results",
)
def leaderboard_macro(spark: SparkSession, d: str) -> DataFrame:
    """Macro score of each model without and with tools, and the difference."""
    return summary.leaderboard(tables.results(spark, d)).select("model", R6("no_tool"), R6("tool"), R6("delta")).orderBy(F.desc("no_tool"))


_SUMMARY = """, s AS (SELECT model, condition, task_type, CAST(grouping(model, condition, task_type) AS INTEGER) AS g, count(*) AS n, avg(CAST(is_correct AS DOUBLE)) AS accuracy, avg(score) AS avg_score,
    avg(judge_score) AS judge, avg(total_tokens) AS tokens, avg(latency_ms) AS latency FROM results GROUP BY GROUPING SETS ((model, condition), (model), (condition), (task_type), ())),
    mm AS (SELECT model, condition, task_type, grouping(model, condition, task_type) + 1 AS g, avg(score) AS m FROM results GROUP BY GROUPING SETS ((model, condition, task_type), (model, task_type), (condition, task_type), (task_type))),
    macro AS (SELECT model, condition, g, avg(m) AS macro FROM mm GROUP BY ALL)
    SELECT s.model, s.condition, s.task_type, s.g AS grouping, n, round(accuracy, 6) AS accuracy, round(avg_score, 6) AS avg_score, round(CASE WHEN s.g <> 6 THEN coalesce(macro, 0) END, 6) AS macro_score,
    round(CASE WHEN s.g IN (1, 7) THEN tokens END, 6) AS avg_tokens, round(CASE WHEN s.g IN (1, 7) THEN latency END, 4) AS avg_latency_ms, round(judge, 6) AS avg_judge_score
    FROM s LEFT JOIN macro ON macro.g = s.g AND macro.model IS NOT DISTINCT FROM s.model AND macro.condition IS NOT DISTINCT FROM s.condition"""


@query(_SUMMARY, "results")
def summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """All summaries in one pass."""
    s = summary.summary(tables.results(spark, d))
    return s.select("model", "condition", "task_type", "grouping", "n", R6("accuracy"), R6("avg_score"), R6("macro_score"), R6("avg_tokens"), F.round("avg_latency_ms", 4).alias("avg_latency_ms"), R6("avg_judge_score"))


@query("SELECT task_type, count(*) AS n, round(avg(CAST(is_correct AS DOUBLE)), 6) AS accuracy, round(avg(score), 6) AS avg_score FROM results GROUP BY task_type", "results")
def summary_by_task(spark: SparkSession, d: str) -> DataFrame:
    """By task type."""
    return tables.results(spark, d).groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(
    """, w AS (SELECT task_type, model, avg(score) FILTER (WHERE condition = 'tool') - avg(score) FILTER (WHERE condition = 'no_tool') AS d FROM results GROUP BY ALL)
    SELECT task_type, count(d) AS n_models, round(avg(d), 6) AS mean_delta, round(stddev_samp(d), 6) AS sd_delta FROM w GROUP BY task_type""",
    "results",
)
def tool_benefit_delta(spark: SparkSession, d: str) -> DataFrame:
    """What tools change, by task type, paired over models."""
    return summary.tool_benefit(tables.results(spark, d)).select("task_type", "n_models", R6("mean_delta"), R6("sd_delta"))


@query("SELECT question_id, model, condition, task_type, status, pos FROM results WHERE model = 'm3' AND contains(task_type, '2') AND NOT is_correct AND status = 'success' AND contains(lower(question_id), '1')", "results")
def results_filter_wrong(spark: SparkSession, d: str) -> DataFrame:
    """A filtered list view."""
    return summary.filtered(tables.results(spark, d), model="m3", task_type="2", status="wrong", id_part="1").select("question_id", "model", "condition", "task_type", "status", "pos")


@query(
    """, c AS (SELECT * FROM results WHERE status IN ('success', 'parse_error', 'api_error', 'tool_error', 'judge_parse_error'))
    SELECT (SELECT count(*) FROM results) AS total, (SELECT count(*) FILTER (WHERE is_correct) FROM results) AS correct, (SELECT count(*) FROM results) - (SELECT count(*) FROM c) AS n_unscored,
    round((SELECT avg(score) FROM c), 4) AS avg_score, round((SELECT avg(m) FROM (SELECT avg(score) AS m FROM c GROUP BY task_type)), 4) AS macro_score""",
    "results",
)
def scorable_policy(spark: SparkSession, d: str) -> DataFrame:
    """Quick stats; rows without a judge can't be scored."""
    return summary.quick_stats(tables.results(spark, d))


@query("SELECT array_to_string(list_sort(list(DISTINCT model)), ',') AS model, array_to_string(list_sort(list(DISTINCT condition)), ',') AS condition, array_to_string(list_sort(list(DISTINCT task_type)), ',') AS task_type FROM results", "results")
def results_facets(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct values to filter by."""
    f = summary.facets(tables.results(spark, d))
    return f.select(*(F.array_join(c, ",").alias(c) for c in f.columns))


@query(
    """, s AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, unnest([CASE WHEN doc_id % 7 <> 0 THEN quality * 5 END, CASE WHEN doc_id % 5 <> 0 THEN toxic * 5 END, CASE WHEN doc_id % 35 <> 0 THEN CAST(doc_id % 6 AS INTEGER) END]) AS score FROM labels)
    SELECT question_id, avg(score) AS mean_score, coalesce(avg(score), 0) / 5 AS normalised, count(score) AS n_judges FROM s GROUP BY question_id""".replace(", s AS", "WITH s AS", 1)
)
def judge_panel_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of a panel, whose members may have given no score."""
    return summary.panel(tables.judge_scores(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS question_id, (toxic * 5 >= 3) AS passes FROM labels WHERE doc_id % 5 <> 0")
def judge_pass_mark(spark: SparkSession, d: str) -> DataFrame:
    """Scores of one judge that pass."""
    j = tables.judge_scores(spark, d).select("question_id", F.col("scores")["j2"].alias("s")).where("s is not null")
    return j.select("question_id", scoring.passes(F.col("s")).alias("passes"))


@query("SELECT model, condition, count(DISTINCT question_id) AS done FROM results GROUP BY ALL", "results")
def evaluation_progress(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return summary.progress(tables.results(spark, d))


@query(
    "SELECT question_id, model, condition, mtime, pos, task_type, score FROM results QUALIFY row_number() OVER (PARTITION BY question_id, model, condition ORDER BY mtime DESC, pos DESC, task_type DESC) = 1", "results"
)
def merge_last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Of rows of one key the last written stays."""
    r = tables.results(spark, d).withColumn("order", F.struct("pos", "task_type"))
    return ordering.last_writer_wins(r, ["question_id", "model", "condition"], "mtime", "order").select("question_id", "model", "condition", "mtime", "pos", "task_type", "score")


@query(
    """, m AS (SELECT DISTINCT model FROM results), c AS (SELECT DISTINCT condition FROM results)
    SELECT m.model, c.condition, count(*) AS open FROM m, c, questions q WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.model = m.model AND r.condition = c.condition AND r.question_id = q.id) GROUP BY ALL""",
    "results",
    "questions",
)
def eval_matrix_resume(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of models, conditions and questions without what is done."""
    r = tables.results(spark, d)
    every = r.groupBy().agg(F.collect_set("model").alias("models"), F.collect_set("condition").alias("conditions"))  # two short lists
    matrix = tables.questions(spark, d).select(F.col("id").alias("question_id")).crossJoin(F.broadcast(every)).select("question_id", F.explode("models").alias("model"), "conditions").select("question_id", "model", F.explode("conditions").alias("condition"))
    left = matrix.join(r.select("question_id", "model", "condition").distinct(), ["question_id", "model", "condition"], "left_anti")
    return left.groupBy("model", "condition").agg(F.count("*").alias("open"))


@query("SELECT model, count(*) AS n, count(*) * (CAST(substr(model, 2) AS INTEGER) * 1500.0 + 800.0 * 2) / 1e6 AS cost FROM results GROUP BY model", "results")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    r = tables.results(spark, d)
    prices = spark.createDataFrame([(f"m{i}", float(i), 2.0) for i in range(11)], "model string, price_in double, price_out double")
    return summary.cost_estimate(r, prices, 1500, 800)


_SINGLE = """coalesce(nullif(upper(regexp_extract(coalesce({t}, ''), '(?is)I select \\(([A-D])\\)', 1)), ''), nullif(upper(regexp_extract(coalesce({t}, ''), '(?is)answer is \\(([A-D])\\)', 1)), ''),
    nullif(upper(regexp_extract(coalesce({t}, ''), '(?is)I select ([A-D])\\b', 1)), ''), nullif(upper(regexp_extract(coalesce({t}, ''), '(?is)answer is ([A-D])\\b', 1)), ''))"""
_PREPARED = r"""
, a AS (SELECT *, regexp_extract_all(coalesce(text, ''), '(?s)<think>(.*?)</think>', 1) AS b1, regexp_replace(text, '(?s)<think>(.*?)</think>', '', 'g') AS c1 FROM responses),
b AS (SELECT *, regexp_extract_all(coalesce(c1, ''), '(?s)<reasoning>(.*?)</reasoning>', 1) AS b2, regexp_replace(c1, '(?s)<reasoning>(.*?)</reasoning>', '', 'g') AS c2 FROM a),
p AS (SELECT id, model, one, text, regexp_replace(c2, '^\s+|\s+$', '', 'g') AS clean,
  CASE WHEN len(b1) + len(b2) > 0 THEN array_to_string(list_transform(list_concat(b1, b2), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10) || chr(10)) END AS thinking FROM b),
n AS (SELECT *, CASE WHEN contains(model, 'mistral') THEN regexp_replace(clean, '\*\*\(([^)]+)\)\*\*', '(\1)', 'g') WHEN contains(model, 'gpt-oss') THEN regexp_replace(clean, '\(([^)\n]{1,30})\s*$', '(\1)') ELSE clean END AS normal,
  array_to_string((string_split(regexp_replace(regexp_replace(coalesce(clean, ''), '^\s+|\s+$', '', 'g'), '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)))[-3:], ' ') AS tail FROM p)"""


@query(_PREPARED + "\nSELECT id, clean, thinking FROM n", "responses")
def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    """TX01."""
    return tables.responses(spark, d).withColumn("s", text.strip_thinking(F.col("text"))).select("id", "s.clean", "s.thinking")


@query(_PREPARED + "\nSELECT id, normal AS text FROM n", "responses")
def normalise_for_model(spark: SparkSession, d: str) -> DataFrame:
    """TX02-TX04, UD4."""
    r = tables.responses(spark, d).withColumn("clean", text.strip_thinking(F.col("text"))["clean"])
    return r.select("id", text.normalise_for_model(F.col("clean"), F.col("model")).alias("text"))


@query(_PREPARED + "\nSELECT id, tail FROM n", "responses")
def tail_sentences(spark: SparkSession, d: str) -> DataFrame:
    """TX05."""
    r = tables.responses(spark, d).withColumn("clean", text.strip_thinking(F.col("text"))["clean"])
    return r.select("id", text.tail_sentences(F.coalesce("clean", F.lit(""))).alias("tail"))


_GATE = r"regexp_matches(tail, '(?i)\b(select|answer|choose|option|go\s+with|pick|therefore|conclude|chosen|choice)\b')"


@query(
    _PREPARED
    + f"""
, v AS (SELECT *, {_SINGLE.format(t="clean")} AS r1, {_SINGLE.format(t="normal")} AS r2, {_SINGLE.format(t="thinking")} AS r3,
  CASE WHEN {_GATE} THEN coalesce(upper(list_last(regexp_extract_all(tail, '(?i)\\(([A-D])\\)', 1))), upper(list_last(regexp_extract_all(tail, '(?i)\\b([A-D])\\b', 1)))) END AS r4 FROM n)
SELECT id, coalesce(r1, r2, r3, r4) AS answer, CASE WHEN r1 IS NOT NULL THEN 'raw' WHEN r2 IS NOT NULL THEN 'normalized' WHEN r3 IS NOT NULL THEN 'thinking' WHEN r4 IS NOT NULL THEN 'low-confidence' END AS how FROM v""",
    "responses",
)
def parse_single(spark: SparkSession, d: str) -> DataFrame:
    """TX06, TX09, TX10: a single-choice answer and where it was found."""
    r = tables.responses(spark, d).withColumn("s", text.strip_thinking(F.col("text")))
    r = r.withColumn("p", text.parse_single(F.col("s.clean"), F.col("s.thinking"), F.col("model")))
    pattern = F.col("p.pattern")
    how = F.when(pattern.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(pattern, r"\[(.*)\]", 1), F.lit("")), F.lit("raw")))
    return r.select("id", "p.answer", how.alias("how"))


def _letters(t: str, pattern: str) -> str:
    inner = f"nullif(regexp_extract(coalesce({t}, ''), '{pattern}', 1), '')"
    return f"""CASE WHEN {inner} IS NULL THEN NULL WHEN upper(trim({inner})) = 'NONE' THEN '' ELSE
        nullif(array_to_string(list_filter(regexp_split_to_array(upper(trim({inner})), '[,\\s]+'), lambda x: regexp_matches(x, '^[A-F]$')), ','), '') END"""


def _multi(t: str) -> str:
    return "coalesce(" + ", ".join(_letters(t, p) for p in (r"(?i)I select \(([^)]+)\)", r"(?i)I select ([A-F](?:\s*,\s*[A-F])*|NONE)\b", r"(?i)answer is \(([^)]+)\)", r"(?i)answer is ([A-F](?:\s*,\s*[A-F])*|NONE)\b")) + ")"


@query(_PREPARED + f"\nSELECT id, coalesce({_multi('clean')}, {_multi('normal')}, {_multi('thinking')}) AS answers FROM n", "responses")
def parse_multi(spark: SparkSession, d: str) -> DataFrame:
    """TX07, TX08, TX11: a multi-select answer; NONE is empty, no answer is null."""
    r = tables.responses(spark, d).withColumn("s", text.strip_thinking(F.col("text")))
    return r.select("id", F.array_join(text.parse_multi(F.col("s.clean"), F.col("s.thinking"), F.col("model"))["answer"], ",").alias("answers"))


@query(
    r"""SELECT id, CAST(coalesce(nullif(regexp_extract(text, '(?is)(?:^|\n)\s*score[:\s]+([0-5])\b', 1), ''), nullif(regexp_extract(text, '(?is)final score[:\s]+([0-5])\b', 1), ''),
    nullif(regexp_extract(text, '(?is)\b([0-5])\s*/\s*5\b', 1), ''), nullif(regexp_extract(text, '(?is)\b([0-5])\s+out\s+of\s+5\b', 1), ''), nullif(regexp_extract(text, '(?is)I (?:give|assign|rate)[^\n]{0,40}\b([0-5])\b', 1), ''),
    list_last(regexp_extract_all(text, '\b([0-5])\b', 1))) AS INTEGER) AS score FROM responses""",
    "responses",
)
def parse_judge(spark: SparkSession, d: str) -> DataFrame:
    """TX12."""
    return tables.responses(spark, d).select("id", text.parse_judge_score(F.col("text"))["answer"].alias("score"))


@query(
    _PREPARED
    + f"""
, v AS (SELECT id, one, text, coalesce({_multi('clean')}, {_multi('normal')}, {_multi('thinking')}) AS answers FROM n),
w AS (SELECT id, list_sort(list_distinct([one, 'C'])) AS gold, CASE WHEN answers = '' THEN [] ELSE list_distinct(string_split(answers, ',')) END AS got, answers IS NULL AS failed FROM v)
SELECT id, CASE WHEN failed THEN 'parse_error' ELSE 'success' END AS status, NOT failed AND coalesce(list_sort(got) = gold, false) AS is_correct,
  CASE WHEN failed OR len(got) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(got, gold)) / (len(got) + len(gold)) END AS score FROM w""",
    "responses",
)
def question_score(spark: SparkSession, d: str) -> DataFrame:
    """Status, correctness and F1 score of parsed multi-select answers."""
    r = tables.responses(spark, d).withColumn("s", text.strip_thinking(F.col("text")))
    r = r.withColumn("answer", text.parse_multi(F.col("s.clean"), F.col("s.thinking"), F.col("model"))["answer"])
    status = scoring.status_of(F.array().cast("array<string>"), F.col("answer"))
    right = scoring.is_correct(F.lit("multi"), F.col("answer"), F.col("gold"))
    score = scoring.question_score(F.lit(None).cast("int"), F.col("status"), F.lit("multi"), F.col("answer"), F.col("gold"), F.col("is_correct"))
    return r.withColumn("status", status).withColumn("is_correct", right).withColumn("score", score).select("id", "status", "is_correct", "score")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'api_error' WHEN id % 3 = 0 THEN 'tool_error' WHEN text IS NULL THEN 'parse_error' ELSE 'success' END AS status, CASE WHEN id % 11 = 0 THEN 'no_judge' WHEN id % 5 = 0 THEN 'api_error' WHEN id % 3 = 0 AND text IS NULL THEN 'tool_error' WHEN id % 2 = 0 THEN 'success' ELSE 'judge_parse_error' END AS judged FROM responses", "responses")
def status_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Which status wins."""
    r = tables.responses(spark, d)
    errors = F.array_compact(F.array(F.when(F.col("id") % 5 == 0, "api_error"), F.when(F.col("id") % 3 == 0, "tool_error")))
    judged = F.when(F.col("id") % 2 == 0, "success").otherwise("parse_error")
    return r.select("id", scoring.status_of(errors, F.col("text")).alias("status"), scoring.judge_status(F.col("id") % 11 != 0, errors, F.col("text"), judged).alias("judged"))


@query(
    r"""SELECT event_id AS id, CASE WHEN event_id % 4 <> 3 THEN event_type END AS name, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS args FROM events"""
)
def icl_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """TX13, M12: tool calls written in a text; arguments that are no object are {}, a call without a name is none."""
    e = tables.read(spark, d, "events")
    written = F.concat(F.lit('Let me see.\nTOOL_CALL: {"name": "'), F.when(F.col("event_id") % 4 != 3, F.col("event_type")).otherwise(""), F.lit('", "args": '), F.when(F.col("event_id") % 4 == 2, "[1]").otherwise(F.col("props")), F.lit("} and so on"))
    return e.select(F.col("event_id").alias("id"), text.parse_tool_call(written).alias("c")).select("id", "c.name", "c.args")


@query(
    r"""SELECT p_partkey AS id, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(p_type || ' the ' || p_name[1:4]), '[a-z0-9_]+')))) > 0 AS overlap,
    replace(replace(lower(p_name), ' ', ''), '-', '') AS squashed, len(list_distinct(regexp_split_to_array(lower(trim(p_name)), '\s+'))) AS n_words FROM part"""
)
def tokenize_overlap(spark: SparkSession, d: str) -> DataFrame:
    """TX16-TX18, F17."""
    from ..operators.validate import shares_words

    p = tables.read(spark, d, "part")
    other = F.concat(F.col("p_type"), F.lit(" the "), F.left("p_name", F.lit(4)))
    return p.select(F.col("p_partkey").alias("id"), shares_words(F.col("p_name"), other).alias("overlap"), text.squashed(F.col("p_name")).alias("squashed"), F.size(text.words(F.col("p_name"))).cast("long").alias("n_words"))


@query(
    r"""SELECT id, upper(split_part(task_type, '-', 1)) AS number, task_type || '_' || left(md5(concat_ws('|', id, descriptor)), 8) AS stable, 'Is ' || descriptor || ' like ' || oa || '?' AS filled,
    left(text, 12) || CASE WHEN length(text) > 12 THEN '...' ELSE '' END AS short,
    repeat(' ', CAST(floor((9 - length(descriptor)) / 2) AS INTEGER) + ((9 - length(descriptor)) & 1)) || descriptor || repeat(' ', (9 - length(descriptor)) - CAST(floor((9 - length(descriptor)) / 2) AS INTEGER) - ((9 - length(descriptor)) & 1)) AS centred FROM questions""",
    "questions",
)
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """TX20, TX22, P07, P08, G05: ids, filled templates, short and centred texts."""
    q = tables.questions(spark, d)
    return q.select(
        "id", text.short_task(F.split_part("task_type", F.lit("-"), F.lit(1)), F.col("id")).alias("number"), text.stable_id(F.col("task_type"), F.col("id"), F.col("descriptor")).alias("stable"),
        text.fill("Is {a} like {b}?", a=F.col("descriptor"), b=F.col("options")["A"]).alias("filled"), text.truncated(F.col("text"), 12).alias("short"), text.centred(F.col("descriptor"), 9).alias("centred"),
    )


@query("SELECT conv_id AS conversation, text AS content FROM conversations WHERE role = 'assistant' AND text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_assistant(spark: SparkSession, d: str) -> DataFrame:
    """W09."""
    from ..operators.replay import last_assistant as last

    return last(tables.messages(spark, d))


@query(
    r"""SELECT conv_id AS conversation, turn, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) || list_last(string_split(text, chr(10) || chr(10))) ELSE '' END AS hint,
    array_to_string((string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)))[-3:], ' ') AS tail FROM conversations"""
)
def message_tails(spark: SparkSession, d: str) -> DataFrame:
    """TX05, TX19 over all messages."""
    return tables.messages(spark, d).select("conversation", "turn", text.answer_format_hint(F.col("content")).alias("hint"), text.tail_sentences(F.col("content")).alias("tail"))


@query("SELECT conversation, sum(tokens)::BIGINT AS total_tokens, count(*) AS turns, count(*) FILTER (WHERE tool IN ('get_parent', 'get_children')) AS reasoning_calls, count(*) FILTER (WHERE tool = 'validate_descriptors') AS validation_calls FROM calls GROUP BY conversation", "calls")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    """A25, D11."""
    from ..operators import replay

    return replay.token_totals(tables.tool_calls(spark, d))


@query("SELECT conversation, event_id, tool, coalesce(sum(CASE WHEN tool IN ('get_parent', 'get_children') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS used_before, coalesce(sum(CASE WHEN tool IN ('get_parent', 'get_children') THEN 1 ELSE 0 END) OVER w, 0) < 5 AS allowed FROM calls WINDOW w AS (PARTITION BY conversation ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "calls")
def budget_replay(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    from ..operators import replay

    return replay.with_budget(tables.tool_calls(spark, d)).select("conversation", "event_id", "tool", "used_before", "allowed")


@query("SELECT conversation, event_id, args, CAST(row_number() OVER (PARTITION BY conversation, args ORDER BY ts, event_id) AS INTEGER) AS repeat, row_number() OVER (PARTITION BY conversation, args ORDER BY ts, event_id) >= 3 AS is_loop FROM calls WHERE tool = 'validate_descriptors'", "calls")
def repeat_index(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    from ..operators import replay

    return replay.repeat_index(tables.tool_calls(spark, d)).select("conversation", "event_id", "args", "repeat", "is_loop")


@query(
    """, c AS (SELECT conversation, args, count(*) AS n FROM calls WHERE tool = 'validate_descriptors' GROUP BY ALL)
    SELECT conversation, max(n) AS max_repeat, count(*) FILTER (WHERE n >= 3) AS n_repeated, (SELECT sum(tokens)::BIGINT FROM calls x WHERE x.conversation = c.conversation) AS total_tokens FROM c GROUP BY conversation HAVING max(n) >= 3""",
    "calls",
)
def retry_loops(spark: SparkSession, d: str) -> DataFrame:
    """A20, O03."""
    from ..operators import replay

    return replay.retry_loops(tables.tool_calls(spark, d))
