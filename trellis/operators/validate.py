"""Checks of questions as columns, their report, and inspections of a question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

# Fixed values.
PROTECTED = ["descriptor", "descriptor1", "descriptor2", "correct_sibling", "distractor1", "distractor2", "distractor3", "target", "option1", "option2", "option3", "closer", "middle", "farther", "odd_one"]
PROTECTED_LISTS = ["similar_group", "candidates", "all_candidates"]
HIDDEN = "ROOT:SYSTEM"


def options_well_formed(options: Column) -> Column:
    return F.coalesce((F.size(options) > 0) & F.forall(F.map_keys(options), lambda k: k.rlike(r"^\p{Lu}$")), F.lit(False))


def answers_among_options(correct: Column, options: Column) -> Column:
    return F.coalesce(F.size(F.array_except(correct, F.map_keys(options))) == 0, F.lit(False))


def options_distinct(options: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.map_values(options))) == F.size(options), F.lit(True))


def no_leak(protected: Column, tool_nodes: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(protected, tool_nodes), F.lit(False))


def no_hidden_root(values: Column) -> Column:
    return ~F.coalesce(F.exists(values, lambda v: v.contains(HIDDEN)), F.lit(False))


def shares_words(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(a), tokens(b)), F.lit(False))


def no_text_overlap(task_type: Column, descriptor: Column, options: Column, parent: Column, target: Column | None = None, nearest: Column | None = None) -> Column:
    """Whether a question can't be told from shared words: by task type as to what may not share words with what."""
    t = target if target is not None else F.lit(None).cast("string")
    n = nearest if nearest is not None else F.lit(None).cast("string")
    default = ~F.exists(F.map_values(options), lambda o: shares_words(descriptor, o)) & ~shares_words(descriptor, parent)
    return F.when(task_type.startswith("A4"), True).when(task_type.startswith("E1") | task_type.startswith("E2"), ~shares_words(t, n)).otherwise(F.coalesce(default, F.lit(True)))


def descriptors_known(questions: DataFrame, names: str, nodes: DataFrame) -> DataFrame:
    """(id): questions all of whose names (an array column) are nodes; found by what is missing."""
    missing = questions.select("id", F.explode(names).alias("name")).where(F.col("name").isNotNull()).join(nodes.select("name"), "name", "left_anti")
    return questions.select("id").join(missing.select("id"), "id", "left_anti")


def report(questions: DataFrame) -> DataFrame:
    """``questions`` (id, text, options, correct) with valid and errors."""
    checks = [
        (F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("task_type").isNotNull(), "missing required fields"),
        (options_well_formed(F.col("options")), "invalid options format"),
        (answers_among_options(F.col("correct"), F.col("options")), "correct answer not in options"),
        (options_distinct(F.col("options")), "duplicate options"),
    ]
    errors = F.array_compact(F.array(*(F.when(~c, F.lit(m)) for c, m in checks)))
    return questions.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def leaks(fields: DataFrame, tool_nodes: DataFrame) -> DataFrame:
    """Of (id, task_type, field, value) those rows whose value is a node that tools can see."""
    return fields.join(tool_nodes.select(F.col("name").alias("value")).distinct(), "value", "left_semi")


def leak_counts(fields: DataFrame, tool_nodes: DataFrame) -> DataFrame:
    return leaks(fields, tool_nodes).groupBy("task_type").agg(F.count_distinct("id").alias("n_questions"), F.count("*").alias("n_fields"))


def distribution(categories: DataFrame) -> DataFrame:
    """(category, n, share): of rows with an array of categories."""
    e = categories.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("n").alias("_all")))).select("category", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))  # one row


def a1_valid(options: Column, correct: Column, valid_roots: Column, all_roots: Column) -> Column:
    """Marked options are exactly the valid roots among the options, and all options are roots."""
    marked = F.transform(correct, lambda k: F.try_element_at(options, k))
    return (F.array_sort(F.array_distinct(marked)) == F.array_sort(F.array_distinct(valid_roots))) & (F.size(F.array_except(F.map_values(options), all_roots)) == 0)


def a2_valid(claims: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Claims (name, ancestor, is_ancestor) with valid: whether they say what the closure says."""
    c = ancestors.select("name", "ancestor", F.lit(True).alias("_is"))
    return claims.join(c, ["name", "ancestor"], "left").withColumn("valid", F.coalesce("_is", F.lit(False)) == F.col("is_ancestor")).drop("_is")
