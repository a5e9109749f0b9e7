"""The engine's inputs as they are derived from the driver's tables, with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "ROOT"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(id, pos, task_type, text, descriptor, options): a question for each order."""
    return read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("task_type"),
        F.concat(F.lit(" Which of these is like "), F.col("o_custkey") % 97, F.lit("? ")).alias("text"),
        F.concat(F.lit("d"), F.col("o_custkey") % 300).alias("descriptor"),
        F.create_map(
            F.lit("A"), F.concat(F.lit("o"), F.col("o_custkey") % 5), F.lit("B"), F.concat(F.lit("o"), (F.col("o_custkey") + 1) % 5), F.lit("C"), F.concat(F.lit("o"), F.col("o_orderkey") % 7)
        ).alias("options"),
        F.array(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("D")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("correct"),
    )


def audit_state(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, status, ts): reviewed questions; what is missing is pending."""
    return (
        read(spark, d, "orders")
        .where(F.col("o_orderstatus").isin("F", "P"))
        .select(F.col("o_orderkey").cast("string").alias("question_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("flagged").alias("status"), F.col("o_orderdate").alias("ts"))
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """One row for each evaluation: question, model, condition, task, score, status, tokens, latency, time of writing."""
    status = F.element_at(F.create_map(*(F.lit(x) for x in ("A", "success", "R", "parse_error", "N", "no_judge"))), F.col("l_returnflag"))
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("question_id"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 11).alias("model"),
        F.when(F.col("l_linestatus") == "F", "no_tool").otherwise("tool").alias("condition"),
        F.concat(F.lit("T"), "l_linenumber").alias("task_type"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_discount") >= 0.05).alias("is_correct"),
        status.alias("status"),
        F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") % 6).cast("int")).alias("judge_score"),
        F.col("l_quantity").cast("long").alias("total_tokens"),
        F.col("l_extendedprice").cast("long").alias("latency_ms"),
        F.col("l_shipdate").alias("mtime"),
        F.col("l_partkey").alias("pos"),
    )


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, scores): a panel of three judges, some of whom gave none."""
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    return read(spark, d, "labels").select(
        i.cast("string").alias("question_id"),
        F.create_map(
            F.lit("j1"), F.when(i % 7 != 0, q * 5).cast("int"), F.lit("j2"), F.when(i % 5 != 0, t * 5).cast("int"), F.lit("j3"), F.when(i % 35 != 0, (i % 6).cast("int"))
        ).alias("scores"),
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(id, model, text, gold): what models wrote, in every form that answers take."""
    one, two = F.char(F.col("event_id") % 4 + 65), F.char(F.col("event_id") % 6 + 65)
    forms = [
        F.concat(F.lit("Therefore, I select ("), one, F.lit(").")),
        F.concat(F.lit("I select **("), one, F.lit(")**")),
        F.concat(F.lit("The answer is "), F.lower(one)),
        F.concat(F.lit("Well. I select ("), one),
        F.lit("I select NONE"),
        F.concat(F.lit("<think>I select ("), one, F.lit(")\nas ever</think> Nothing <reasoning> more </reasoning>here. ")),
        F.concat(F.lit("First, one. Then I would choose ("), one, F.lit(") or so!\nOr ("), F.char(F.col("event_id") % 3 + 65), F.lit("). Done.")),
        F.lit("no idea at all"),
        F.concat(F.lit("Therefore, I select ("), two, F.lit(", C).")),
        F.concat(F.lit("answer is "), two, F.lit(", D, F")),
        F.concat(F.lit("Fine work.\nScore: "), F.col("event_id") % 6, F.lit("\nI pick it.")),
        F.concat(F.lit("I give this a solid "), F.col("event_id") % 6, F.lit(" in all; it was 3 or 4 at first")),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 12 + 1).cast("int"))
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(F.lit("x/mistral-medium"), F.lit("x/gpt-oss-120b"), F.lit("x/other")), (F.col("event_id") % 5 % 3 + 1).cast("int")).alias("model"),
        F.when(F.col("event_id") % 97 != 0, text).alias("text"),
        F.array(one, F.lit("C")).alias("gold"),
    )


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """(conversation, turn, tool, args): calls in order of time."""
    return read(spark, d, "events").select(
        F.col("user_id").alias("conversation"),
        F.struct("ts", "event_id").alias("turn"),
        F.element_at(
            F.create_map(*(F.lit(x) for x in ("view", "validate_descriptors", "click", "get_parent", "purchase", "get_children", "signup", "answer", "error", "answer"))), F.col("event_type")
        ).alias("tool"),
        F.concat_ws(",", F.array_sort(F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 9), F.lit("k3")))).alias("args"),
        F.floor("value").cast("long").alias("tokens"),
        F.col("event_id"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", F.col("text").alias("content"))


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, ord) and edges (source, target, path_type, eid) of root, regions, nations and customers."""
    r, n, c = read(spark, d, "region"), read(spark, d, "nation"), read(spark, d, "customer")
    edges = (
        r.select(F.lit(ROOT).alias("source"), F.col("r_name").alias("target"), F.lit("sub-category").alias("path_type"), (F.col("r_regionkey") + 1).cast("long").alias("eid"))
        .unionByName(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("sub-category").alias("path_type"), (F.col("n_nationkey") + 100).cast("long").alias("eid")))
        .unionByName(
            c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
                F.col("n_name").alias("source"), F.col("c_name").alias("target"), F.when(F.col("c_custkey") % 3 == 0, "related").otherwise("sub-category").alias("path_type"), (F.col("c_custkey") + 1000).alias("eid")
            )
        )
    )
    nodes = edges.select(F.col("target").alias("name"), F.col("eid").alias("ord")).unionByName(spark.createDataFrame([(ROOT, 0)], "name string, ord long"))
    return nodes, edges


def dag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges where many nodes have several parents: root, nations, suppliers, and the parts they supply."""
    n, s, li = read(spark, d, "nation"), read(spark, d, "supplier"), read(spark, d, "lineitem")
    edges = (
        n.select(F.lit(ROOT).alias("source"), F.col("n_name").alias("target"), (F.col("n_nationkey") + 1).cast("long").alias("eid"))
        .unionByName(s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("source"), F.col("s_name").alias("target"), (F.col("s_suppkey") + 1000).alias("eid")))
        .unionByName(
            li.select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == s.s_suppkey).select(F.col("s_name").alias("source"), F.concat(F.lit("part"), "l_partkey").alias("target"), (F.col("l_partkey") + 10_000_000).alias("eid"))
        )
        .withColumn("path_type", F.lit("sub-category"))
    )
    nodes = edges.groupBy(F.col("target").alias("name")).agg(F.min("eid").alias("ord")).unionByName(spark.createDataFrame([(ROOT, 0)], "name string, ord long"))
    return nodes, edges
