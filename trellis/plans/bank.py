"""Queries over the question bank, its review and its queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering, review, validate
from ..sources import tables
from .registry import query

_S = ", s AS (SELECT q.*, coalesce(a.status, 'pending') AS status FROM questions q LEFT JOIN audit a ON a.question_id = q.id)"


@query(_S + " SELECT id, task_type, status FROM s", "questions", "audit")
def pending_left_join(spark: SparkSession, d: str) -> DataFrame:
    """The status of every question; what has no entry is pending."""
    return review.with_status(tables.questions(spark, d), tables.audit_state(spark, d)).select("id", "task_type", "status")


@query(_S + " SELECT id, task_type FROM s WHERE status = 'confirmed'", "questions", "audit")
def confirmed_semi(spark: SparkSession, d: str) -> DataFrame:
    """J02, K13."""
    return review.confirmed(tables.questions(spark, d), tables.audit_state(spark, d)).select("id", "task_type")


@query(", o AS (SELECT * FROM questions WHERE pos % 3 <> 0) SELECT id, pos FROM o UNION ALL SELECT id, pos FROM questions WHERE pos % 3 = 0", "questions")
def new_ids_anti(spark: SparkSession, d: str) -> DataFrame:
    """Only questions whose id is new are added."""
    q = tables.questions(spark, d)
    return review.added(q.where("pos % 3 <> 0").select("id", "pos"), q.where("pos % 2 = 0 or pos % 3 = 0").select("id", "pos"))


@query(", q AS (SELECT id FROM questions WHERE pos % 4 <> 0) SELECT status, count(*) AS n FROM audit WHERE question_id NOT IN (SELECT id FROM q) GROUP BY status", "questions", "audit")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the audit without a question, by status."""
    return review.orphans(tables.audit_state(spark, d), tables.questions(spark, d).where("pos % 4 <> 0")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    _S + """ SELECT task_type, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'flagged') AS flagged, count(*) AS total FROM s GROUP BY task_type""",
    "questions",
    "audit",
)
def queue_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A10, A11, A15, A24."""
    return review.queue_stats(tables.questions(spark, d), tables.audit_state(spark, d))


@query(_S + " SELECT id, status FROM s WHERE task_type IN ('1-URGENT', '5-LOW') AND status IN ('pending', 'flagged') AND status NOT IN ('flagged')", "questions", "audit")
def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    """F03, F02."""
    return review.filter_queue(tables.questions(spark, d), tables.audit_state(spark, d), ["1-URGENT", "5-LOW"], ["pending", "flagged"], ["flagged"]).select("id", "status")


@query(
    _S + """ SELECT id, row_number() OVER (ORDER BY CASE WHEN task_type = '2-HIGH' AND status <> 'confirmed' THEN 0 WHEN task_type = '3-MEDIUM' AND status <> 'confirmed' THEN 1 WHEN status = 'confirmed' THEN 2 ELSE 3 END, pos) AS new_pos FROM s""",
    "questions",
    "audit",
)
def queue_reorder(spark: SparkSession, d: str) -> DataFrame:
    """W07, O01, UD8: reorder by rules, stable, the rest last."""
    s = review.with_status(tables.questions(spark, d), tables.audit_state(spark, d))
    open_ = F.col("status") != "confirmed"
    return ordering.by_rules(s, "pos", [(F.col("task_type") == "2-HIGH") & open_, (F.col("task_type") == "3-MEDIUM") & open_, ~open_]).select("id", "new_pos")


@query(", f AS (SELECT id, row_number() OVER (ORDER BY task_type <> '4-NOT SPECIFIED', pos) AS front, row_number() OVER (ORDER BY task_type = '4-NOT SPECIFIED', pos) AS back FROM questions) SELECT * FROM f", "questions")
def queue_move(spark: SparkSession, d: str) -> DataFrame:
    """What matches to the front, or to the back."""
    q = tables.questions(spark, d)
    m = F.col("task_type") == "4-NOT SPECIFIED"
    front = ordering.to_front(q, "pos", m).select("id", F.col("new_pos").alias("front"))
    return front.join(ordering.to_back(q, "pos", m).select("id", F.col("new_pos").alias("back")), "id")


@query(_S + ", t AS (SELECT id, pos FROM s WHERE status = 'pending' ORDER BY pos LIMIT 20) SELECT id, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS place FROM t", "questions", "audit")
def queue_pending_head(spark: SparkSession, d: str) -> DataFrame:
    """The next pending questions with their places."""
    s = review.with_status(tables.questions(spark, d), tables.audit_state(spark, d)).where("status = 'pending'")
    return ordering.head(s, "pos", 20).select("id", "place")


@query(_S + ", t AS (SELECT * FROM s WHERE status <> 'confirmed' ORDER BY pos LIMIT 15) SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS place, id, task_type, status, left(text, 100) AS text FROM t", "questions", "audit")
def queue_preview(spark: SparkSession, d: str) -> DataFrame:
    """P08."""
    return review.preview(tables.questions(spark, d), tables.audit_state(spark, d), 15)


@query(_S + " SELECT id, pos FROM s WHERE status = 'pending' AND pos % 50 <> 0 ORDER BY pos LIMIT 1", "questions", "audit")
def next_to_review(spark: SparkSession, d: str) -> DataFrame:
    """UD10."""
    q = tables.questions(spark, d)
    return review.next_to_review(q, tables.audit_state(spark, d), q.where("pos % 50 = 0").select("id")).select("id", "pos")


@query(_S + """ SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'flagged') AS flagged,
    CAST(trunc(count(*) FILTER (WHERE status = 'confirmed') * 100 / count(*)) AS INTEGER) AS progress FROM s""", "questions", "audit")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    """A12, A13, J16, M07."""
    return review.audit_stats(tables.questions(spark, d), tables.audit_state(spark, d))


_FILES = """, e AS (SELECT question_id, status, ts, 0 AS source FROM audit UNION ALL SELECT question_id, 'confirmed', ts + INTERVAL 1 DAY * (CAST(question_id AS BIGINT) % 3 - 1), 1 FROM audit WHERE CAST(question_id AS BIGINT) % 4 = 0)"""


def _state_files(spark: SparkSession, d: str) -> DataFrame:
    a = tables.audit_state(spark, d)
    n = F.col("question_id").cast("long")
    later = a.where(n % 4 == 0).select("question_id", F.lit("confirmed").alias("status"), F.timestamp_add("DAY", n % 3 - 1, F.col("ts")).alias("ts"), F.lit(1).alias("source"))
    return a.withColumn("source", F.lit(0)).unionByName(later)


@query(_FILES + " SELECT question_id, status, ts, source FROM e QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY ts DESC, source) = 1", "audit")
def audit_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """W02, DT02: of several state files the latest entry; of equal times the first."""
    return ordering.keep_latest(_state_files(spark, d), "question_id", "ts", "source")


@query(_FILES + " SELECT count(*) AS entries, count(DISTINCT question_id) AS total, count(*) - count(DISTINCT question_id) AS conflicts FROM e", "audit")
def audit_merge_stats(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    return review.merge_stats(_state_files(spark, d))


@query(_FILES + """, f AS (SELECT question_id, CASE WHEN CAST(question_id AS BIGINT) % 9 = 0 THEN 'odd' ELSE status END AS status, ts, CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 THEN 'why' END AS reason FROM e)
    SELECT question_id, 'unknown status' AS problem FROM f WHERE status = 'odd' UNION ALL SELECT question_id, 'flag without reason' FROM f WHERE status = 'flagged' AND reason IS NULL
    UNION ALL SELECT question_id, 'several entries' FROM f GROUP BY question_id HAVING count(*) > 1""", "audit")
def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    """F24."""
    n = F.col("question_id").cast("long")
    s = _state_files(spark, d).withColumn("flag_reason", F.when(n % 2 == 0, "why")).withColumn("status", F.when(n % 9 == 0, "odd").otherwise(F.col("status")))
    return review.violations(s)


@query(", u AS (SELECT * FROM audit WHERE CAST(question_id AS BIGINT) % 10 <> 0 UNION ALL SELECT id, 'confirmed', TIMESTAMP '2020-01-01' FROM questions WHERE pos % 10 = 0) SELECT status, count(*) AS n FROM u GROUP BY status", "audit", "questions")
def audit_upsert(spark: SparkSession, d: str) -> DataFrame:
    """UD7, K04: confirmed questions take the place of their entries."""
    changes = tables.questions(spark, d).where("pos % 10 = 0").select(F.col("id").alias("question_id"), F.lit("confirmed").alias("status"), F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"))
    state = tables.audit_state(spark, d)
    return review.upsert(state, changes.withColumn("ts", F.col("ts").cast(state.schema["ts"].dataType))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT id, row_number() OVER (PARTITION BY descriptor ORDER BY pos) > 1 AS is_duplicate FROM questions", "questions")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """W03."""
    return ordering.first_occurrence(tables.questions(spark, d), "descriptor", "pos").select("id", "is_duplicate")


@query(
    """, n AS (SELECT id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY task_type) AS n FROM questions),
    k AS (SELECT unnest(range(37)) AS j) SELECT id, task_type FROM n WHERE n <= 37 OR i IN (SELECT CAST(floor(j * n.n / 37.0) AS BIGINT) FROM k)""",
    "questions",
)
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """W04."""
    return ordering.stride_sample(tables.questions(spark, d), "task_type", "pos", 37).select("id", "task_type")


@query(
    """, k AS (SELECT id, pos, lower(trim(text)) AS t, array_to_string(list_sort(list_distinct([oa, ob, oc])), ',') AS o FROM questions), c AS (SELECT k.* FROM k JOIN audit a ON a.question_id = k.id AND a.status = 'confirmed')
    SELECT k.id, f.first AS duplicate_of FROM k JOIN (SELECT t, o, arg_min(id, pos) AS first FROM c GROUP BY t, o) f ON f.t = k.t AND f.o = k.o AND f.first <> k.id""",
    "questions",
    "audit",
)
def duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    """The same text and set of options as a confirmed question."""
    q = tables.questions(spark, d)
    return review.duplicate_questions(q, review.confirmed(q, tables.audit_state(spark, d)))


@query("SELECT task_type, descriptor, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM questions GROUP BY ALL HAVING count(*) > 1", "questions")
def duplicate_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return review.duplicate_descriptors(tables.questions(spark, d)).withColumn("ids", F.array_join("ids", ","))


@query(
    """ SELECT id, array_to_string(list_concat(CASE WHEN correct = 'D' THEN ['correct answer not in options'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN oa = oc OR ob = oc OR oa = ob THEN ['duplicate options'] ELSE CAST([] AS VARCHAR[]) END), ';') AS errors,
    NOT (correct = 'D' OR oa = oc OR ob = oc OR oa = ob) AS valid FROM questions""",
    "questions",
)
def validator_report(spark: SparkSession, d: str) -> DataFrame:
    """F10-F12, F14, F20, F21."""
    return validate.report(tables.questions(spark, d)).select("id", F.array_join("errors", ";").alias("errors"), "valid")


@query("SELECT task_type, count(DISTINCT id) AS n_questions, count(*) AS n_fields FROM (SELECT id, task_type, unnest(['d' || substr(descriptor, 2), oa, oc]) AS v FROM questions) WHERE v IN (SELECT 'o' || r_regionkey FROM region UNION ALL SELECT 'd' || n_nationkey FROM nation) GROUP BY task_type", "questions")
def leakage(spark: SparkSession, d: str) -> DataFrame:
    """Protected names that tools can see."""
    q = tables.questions(spark, d)
    fields = q.select("id", "task_type", F.explode(F.array("descriptor", F.col("options")["A"], F.col("options")["C"])).alias("value")).withColumn("field", F.lit("name"))
    r, n = tables.read(spark, d, "region"), tables.read(spark, d, "nation")
    nodes = r.select(F.concat(F.lit("o"), "r_regionkey").alias("name")).unionByName(n.select(F.concat(F.lit("d"), "n_nationkey").alias("name")))
    return validate.leak_counts(fields, nodes)


@query(", c AS (SELECT unnest([oa, oc]) AS category FROM questions) SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY category", "questions")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A14, A19, A28."""
    q = tables.questions(spark, d).select(F.array(F.col("options")["A"], F.col("options")["C"]).alias("categories"))
    return validate.distribution(q).withColumn("share", F.round("share", 6))


@query(
    """WITH b AS (SELECT 'file' || (s_suppkey % 5) AS file, 'b' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '_v' || s_suppkey END AS name, s_acctbal AS mtime FROM supplier)
    SELECT file, name FROM b QUALIFY row_number() OVER (PARTITION BY file ORDER BY mtime DESC, name DESC) > 2"""
)
def backup_retention(spark: SparkSession, d: str) -> DataFrame:
    """What goes beyond the newest two of each file."""
    s = tables.read(spark, d, "supplier")
    name = F.concat(F.lit("b"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("_v"), "s_suppkey")))
    b = s.select(F.concat(F.lit("file"), F.col("s_suppkey") % 5).alias("file"), name.alias("name"), F.col("s_acctbal").alias("mtime"))
    return review.backups_to_delete(b, 2).select("file", "name")


@query("SELECT max(s_suppkey) AS version FROM supplier WHERE s_suppkey % 3 <> 0")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Names without a number are passed over."""
    s = tables.read(spark, d, "supplier")
    return review.latest_version(s.select(F.concat(F.lit("b"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("_v"), "s_suppkey"))).alias("name")))
