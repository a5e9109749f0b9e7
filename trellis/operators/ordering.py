"""Operators whose result depends on an order: merging writers, keeping the latest, first occurrences, strides, queues.

Order is always a column; nothing relies on the order in which rows happen to lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import kept


def last_writer_wins(results: DataFrame, keys: list[str], mtime: str, pos: str) -> DataFrame:
    """One row for each key: the last written, then of the highest position. Rows with a null in a key go."""
    whole = results
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    order = Window.partitionBy(*keys).orderBy(F.desc(mtime), F.desc(pos))
    return whole.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def keep_latest(states: DataFrame, key: str, ts: str, source: str) -> DataFrame:
    """One row for each key: of the latest time; of equal times the one of the first source stays."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.asc(source))
    return states.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def first_occurrence(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """``rows`` with is_duplicate: whether the value was there at a lower position; rows without a value never are."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(pos).alias("_first"))
    return rows.join(first, value, "left").withColumn("is_duplicate", F.coalesce(F.col(pos) > F.col("_first"), F.lit(False))).select(*rows.columns, "is_duplicate")


def numbered_in(rows: DataFrame, group: str, order: list[str], name: str, size: str) -> DataFrame:
    """``rows`` with their number from 0 in each group, and the group's size; numbered by ranges, so that a group may hold any share of the rows. Null is a group."""
    whole = kept(numbered(rows, [group, *order], "_no"))
    of = whole.groupBy(F.col(group).alias("_group")).agg(F.min("_no").alias("_least"), F.count("*").alias(size))
    return whole.join(of, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_no") - F.col("_least")).drop("_no", "_least", "_group")


def stride_sample(rows: DataFrame, group: str, pos: str, n: int) -> DataFrame:
    """``n`` rows of each group, evenly spaced: those at floor(i * size / n); all of a group of at most ``n``."""
    whole = numbered_in(rows, group, [pos], "_i", "_n")
    # i is taken if it is floor(j * size / n) for some j, that is for j = ceil(i * n / size)
    j = F.ceil(F.col("_i") * F.lit(n) / F.col("_n"))
    taken = (F.col("_n") <= n) | ((j < n) & (F.floor(j * F.col("_n") / F.lit(n)) == F.col("_i")))
    return whole.where(taken).drop("_i", "_n")


def by_rules(queue: DataFrame, pos: str, rules: list[Column]) -> DataFrame:
    """``queue`` with new_pos from 1: rows of the first rule that holds come in the order of the rules, the rest last; stable."""
    bucket = F.lit(len(rules))
    for i, r in reversed(list(enumerate(rules))):
        bucket = F.when(r, i).otherwise(bucket)
    return numbered(queue.withColumn("_bucket", bucket), ["_bucket", pos], "new_pos").drop("_bucket")


def to_front(queue: DataFrame, pos: str, which: Column) -> DataFrame:
    return by_rules(queue, pos, [which])


def to_back(queue: DataFrame, pos: str, which: Column) -> DataFrame:
    return by_rules(queue, pos, [~which])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number, from 1, in a total order, by ranges: no task holds all rows.

    Rows are dealt by ranges of the order, written with the number of their range, so that no second run of a task
    can deal them otherwise, and numbered in it; what lies in lower ranges, one count for each of them, is added.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_many"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def head(queue: DataFrame, pos: str, n: int) -> DataFrame:
    """The first ``n`` rows with their place; only ``n`` rows of each task come together."""
    top = queue.orderBy(pos).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(pos)))


def tiered(candidates: DataFrame, key: list[str], item: str, n: int, seed: str) -> DataFrame:
    """Of each key ``n`` items, lower tiers first and by hash within a tier; an item counts in its lowest tier."""
    best = candidates.groupBy(*key, item).agg(F.min("tier").alias("tier"))
    order = Window.partitionBy(*key).orderBy("tier", F.md5(F.concat_ws("|", F.lit(seed), *key, item)), item)
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def spaced_levels(distances: DataFrame, n: int, min_gap: int, seed: str) -> DataFrame:
    """(target, name, distance): up to ``n`` names for each target, one for each distance, distances at least ``min_gap`` apart, nearest first."""
    one = distances.groupBy("target", "distance").agg(F.min_by("name", F.struct(F.md5(F.concat_ws("|", F.lit(seed), "target", "name")), F.col("name"))).alias("name"))
    levels = one.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("distance", "name"))).alias("ls"))  # one entry for each distance
    empty = F.slice("ls", 1, 0)
    chosen = F.aggregate(
        "ls", empty, lambda a, x: F.when((F.size(a) < n) & ((F.size(a) == 0) | (x["distance"] - F.try_element_at(a, F.lit(-1))["distance"] >= min_gap)), F.concat(a, F.array(x))).otherwise(a)
    )
    return levels.select("target", F.explode(chosen).alias("x")).select("target", "x.name", "x.distance")
