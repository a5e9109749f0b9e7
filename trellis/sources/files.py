"""Files of hierarchies, questions, results and review states, read with declared schemas; and how they are written.

Schemas are declared because a question's answer changes its type from row to row. Files that can't be parsed are
passed over, as a cache that is being written must not stop a summary.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy

EDGE = "struct<source:string,target:string,path_type:string>"
QUESTION = "id string, category string, task_type string, text string, options map<string,string>, correct_answer variant, answer_format string, status string, _objects variant"
RESULT = (
    "question_id string, model string, condition string, task_type string, status string, score double, is_correct boolean, judge_score int, "
    "metrics struct<reasoning_calls:int,validation_calls:int,total_turns:int,input_tokens:long,output_tokens:long,total_tokens:long,latency_ms:long,answered_early:boolean>"
)


def read_graph(spark: SparkSession, path: str) -> Hierarchy:
    """A hierarchy of a JSON document {graph_name, root, descriptions, connections}; edges as objects or as pairs. Other suffixes are refused."""
    if PurePosixPath(path).suffix != ".json":
        raise ValueError(f"only .json graphs can be read, not {path}")
    doc = spark.read.option("multiLine", True).schema("root string, descriptions array<string>, connections variant").json(path)
    nodes = doc.select(F.posexplode("descriptions").alias("ord", "name")).select("name", F.col("ord").cast("long").alias("ord"))
    listed = doc.select(F.posexplode(F.expr("cast(connections as array<variant>)")).alias("eid", "c"))
    get = lambda field, at: F.coalesce(F.try_variant_get("c", f"$.{field}", "string"), F.try_variant_get("c", f"$[{at}]", "string"))
    edges = listed.select(get("source", 0).alias("source"), get("target", 1).alias("target"), F.coalesce(get("path_type", 2), F.lit("sub-category")).alias("path_type"), F.col("eid").cast("long").alias("eid"))
    root = doc.select("root").first()
    return Hierarchy(nodes, edges, (root and root.root) or "ROOT")


def graph_from_rows(spark: SparkSession, descriptions: list[str], connections: list[dict], root: str) -> Hierarchy:
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(descriptions)], "name string, ord long")
    edges = spark.createDataFrame([(c["source"], c["target"], c.get("path_type", "sub-category"), i) for i, c in enumerate(connections)], "source string, target string, path_type string, eid long")
    return Hierarchy(nodes, edges, root)


def flattened(connections: DataFrame) -> DataFrame:
    """(source, target, path_type): of a map from source to a list of edges."""
    return connections.select(F.explode("m").alias("source", "es")).select("source", F.explode("es").alias("e")).select("source", "e.target", "e.path_type")


def read_questions(spark: SparkSession, path: str, with_rejected: bool = False) -> DataFrame:
    """Questions of a document that is a list or has one under ``questions``; with ``correct`` (letters) and ``kind`` (single, multi, open)."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    inside = F.try_variant_get("v", "$.questions", "array<variant>")
    rows = whole.select(F.posexplode(F.coalesce(inside, F.try_variant_get("v", "$", "array<variant>"))).alias("pos", "q"))
    get = lambda f, t="string": F.try_variant_get("q", f"$.{f}", t)
    many, one = get("correct_answer", "array<string>"), get("correct_answer")
    is_list = F.schema_of_variant(F.try_variant_get("q", "$.correct_answer", "variant")).startswith("ARRAY")
    out = rows.select(
        get("id").alias("id"), F.col("pos").cast("long").alias("pos"), get("category").alias("category"), get("task_type").alias("task_type"), get("text").alias("text"),
        get("options", "map<string,string>").alias("options"), F.when(is_list, many).when(one.isNotNull(), F.array(one)).alias("correct"),
        F.when(is_list, "multi").when(one.isNotNull(), "single").otherwise("open").alias("kind"), get("status").alias("status"), get("_objects.descriptor").alias("descriptor"),
    )
    return out if with_rejected else out.where(F.coalesce("status", F.lit("")) != "rejected")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, status, ts, notes, flag_reason) of a JSON object from ids to entries."""
    whole = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,struct<status:string,timestamp:string,notes:string,flag_reason:string>>")
    return whole.select(F.explode(m).alias("question_id", "s")).select("question_id", "s.status", F.try_to_timestamp(F.col("s.timestamp")).alias("ts"), "s.notes", "s.flag_reason")


def read_result_cache(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Result documents below ``path``; model, condition and question id are those of the path <model...>/<condition>/<id>.json."""
    base = path.rstrip("/")
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = raw.schema(RESULT + ", _bad string").json(base).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("mtime"))
    parts = F.split(F.element_at(F.split("_path", f"{PurePosixPath(base).name}/", 2), -1), "/")
    n = F.size(parts)
    return (
        rows.where("_bad is null")
        .withColumns({
            "question_id": F.regexp_replace(F.element_at(parts, -1), r"\.json$", ""),
            "condition": F.try_element_at(parts, F.lit(-2)),
            "model": F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "/"),
        })
        .drop("_bad", "_path")
    )


def read_flagged(spark: SparkSession, path: str) -> DataFrame:
    """Flagged questions, one JSON object a line; blank lines are none."""
    return spark.read.schema("id string, reason string, notes string, timestamp string").json(path).where("id is not null")


def write_partitioned(results: DataFrame, path: str) -> None:
    """Results in one folder for each model and condition, so that reading some of them reads no others."""
    results.write.mode("overwrite").partitionBy("model", "condition").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    board.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each model
