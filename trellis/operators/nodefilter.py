"""The staged filter of nodes: structure, category, quality, exceptions; with its funnel and the reasons."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterConfig:
    leaf_only: bool = True
    min_depth: int | None = 2
    max_depth: int | None = None
    # Fixed values.
    excluded_parents: tuple[str, ...] = ("taste", "defected", "other")
    excluded_keywords: tuple[str, ...] = ("ROOT:", "overall", "general", "basic")
    min_siblings: int = 0
    blacklist: tuple[str, ...] = field(default=())
    whitelist: tuple[str, ...] = field(default=())

    def updated(self, **changes) -> FilterConfig:
        return replace(self, **changes)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def staged(facts: DataFrame, config: FilterConfig) -> DataFrame:
    """``facts`` with structural, categorical, quality (each given those before), kept and the reasons against."""
    low = F.lower("name")
    too_shallow = F.col("depth") < (config.min_depth if config.min_depth is not None else -1)
    too_deep = F.col("depth") > config.max_depth if config.max_depth is not None else F.lit(False)
    not_leaf = ~F.col("is_leaf") if config.leaf_only else F.lit(False)
    parent = F.coalesce(F.col("parent").isin(list(config.excluded_parents)), F.lit(False)) if config.excluded_parents else F.lit(False)
    keyword = F.coalesce(*(F.when(low.contains(k.lower()), F.lit(k)) for k in config.excluded_keywords), F.lit(None).cast("string"))
    few = F.col("n_siblings") < config.min_siblings
    reasons = F.array_compact(F.array(
        F.when(not_leaf, "not_leaf"), F.when(too_shallow, "too_shallow"), F.when(too_deep, "too_deep"),
        F.when(parent, F.concat(F.lit("parent:"), "parent")), F.when(keyword.isNotNull(), F.concat(F.lit("keyword:"), keyword)), F.when(few, "few_siblings"),
    ))
    out = facts.withColumn("structural", ~(not_leaf | too_shallow | too_deep)).withColumn("categorical", F.col("structural") & ~parent & keyword.isNull())
    out = out.withColumn("quality", F.col("categorical") & ~few).withColumn("reasons", reasons)
    listed = lambda names: F.col("name").isin(list(names)) if names else F.lit(False)
    return out.withColumn("kept", (F.col("quality") & ~listed(config.blacklist)) | listed(config.whitelist))


def funnel(facts: DataFrame, config: FilterConfig) -> DataFrame:
    """(total, after_structural, after_category, after_quality, final, rate): rate as a percentage with one decimal."""
    s = staged(facts, config).agg(
        F.count("*").alias("total"), F.count_if("structural").alias("after_structural"), F.count_if("categorical").alias("after_category"), F.count_if("quality").alias("after_quality"), F.count_if("kept").alias("final")
    )
    return s.withColumn("rate", F.format_string("%.1f%%", F.when(F.col("total") > 0, F.col("final") * 100.0 / F.col("total")).otherwise(0.0)))


def by_parent(facts: DataFrame, config: FilterConfig) -> DataFrame:
    return staged(facts, config).where("kept").groupBy("parent").agg(F.array_sort(F.collect_list("name")).alias("names"))


def read_names(lines: DataFrame) -> DataFrame:
    """(name): of a list with one name a line; empty lines and those that begin with # are no names."""
    name = F.trim("value")
    return lines.where((name != "") & ~name.startswith("#")).select(name.alias("name")).distinct()
