"""Questions with several right answers, drawn as a whole bank: paths of different root categories, ancestors of deep pairs.

Everything is drawn by place (see ``places``), so that a question costs what it holds, however large a root category or
a node's descendants are. The same seed gives the same bank. Questions for which something is lacking are not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_nodes, with_footnote
from ..steps import kept
from .drawing import shared_out
from .generate import A4_WEIGHTS, A5_WEIGHTS, draw, weighted
from .ordering import numbered
from .places import deep_pairs, drawn, family, hashed, preorder, ranges

OPTIONS = 5
#: How many of a hundred wrong paths have another root; the lengths of paths that are asked about.
OTHER_ROOT, LENGTHS = 30, (3, 4)
_NO_PLACES = "cast(array() as array<bigint>)"


def in_order(options: DataFrame, key: list[str], seed: str) -> DataFrame:
    """(key, options, correct) from rows (key, option, right): options by hash, letters of the right ones."""
    at = F.md5(F.concat_ws("|", F.lit(seed), *key, "option"))
    got = options.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at.alias("h"), "option", "right"))).alias("_o"))  # five for each question
    letters = F.array_compact(F.transform("_o", lambda o, i: F.when(o["right"], F.char(i + 65))))
    return got.select(*key, F.transform("_o", lambda o: o["option"]).alias("options"), F.array_join(letters, ",").alias("correct"))


def paths_of_roots(order: DataFrame, inner: DataFrame, count: int, seed: str, used: DataFrame | None = None, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(question, slot, right, root, name, option): five paths for each of ``count`` questions, right ones of different root categories.

    ``order`` is ``preorder``'s table, ``inner`` has the names of nodes with children. How many paths are right is drawn by
    ``A4_WEIGHTS``; their root categories are drawn without repeats, a wrong path's root goes by how many leaves roots have.
    Each slot gets a leaf of its root that no other slot of any question gets, nor one of ``used`` (name). A wrong path keeps its
    ends and has other middle nodes of its root, or has another root and middle nodes of that. Questions that
    lack a root, a leaf or a middle node are not made.
    """
    paths = order.where("depth > 0").withColumn("path", F.expr("slice(path, 2, size(path) - 1)")).withColumn("root", F.get("path", F.lit(0)))
    leaves = paths.where((F.col("n") == 0) & F.size("path").isin(*lengths)).select("name", "root", "path")
    if used is not None:
        leaves = leaves.join(used.select("name"), "name", "left_anti")
    leaves = kept(leaves)
    middles = kept(numbered(paths.where("depth > 1").join(inner.select("name"), "name", "left_semi").select("name", "root"), ["root", "name"], "at"))
    roots = leaves.groupBy("root").agg(F.count("*").alias("leaves")).join(middles.groupBy("root").agg(F.min("at").alias("m_start"), F.count("*").alias("m_n")), "root", "left")
    roots = kept(numbered(roots, ["root"], "no"))  # one row for each root category
    before = numbered(leaves.select("root", "name"), ["root", "name"], "leaf").select("leaf", F.col("root").alias("of_leaf"))
    totals = roots.agg(F.count("*").alias("r"), F.sum("leaves").alias("l")).first()
    if not totals.r:
        return leaves.select(F.lit(0).cast("long").alias("question"), F.lit(0).alias("slot"), F.lit(True).alias("right"), "root", "name", F.lit("").alias("option")).limit(0)
    q = leaves.sparkSession.range(count).withColumnRenamed("id", "question").withColumn("n", weighted(draw(seed, "n4", F.col("question").cast("string")), A4_WEIGHTS))
    q = q.withColumns({"_of": ranges((F.lit(1), F.lit(totals.r))), "_none": F.expr(_NO_PLACES)}).withColumn("_roots", drawn("_of", "_none", "n", seed, "concat('roots|', question)"))
    slots = q.select("question", "n", "_roots", F.explode(F.sequence(F.lit(0), F.lit(OPTIONS - 1))).alias("slot")).where("size(_roots) = n")
    slots = slots.select("question", "slot", (F.col("slot") < F.col("n")).alias("right"), F.get("_roots", F.col("slot")).alias("no"), F.expr(f"1 + {hashed(seed, 'concat(question, chr(124), slot)')} % {totals.l}").alias("leaf"))
    good = slots.where("right").join(roots.select("no", "root"), "no")
    bad = slots.where("not right").join(before, "leaf").withColumnRenamed("of_leaf", "root")
    asked = good.select("question", "slot", "right", "root").unionByName(bad.select("question", "slot", "right", "root")).withColumn("id", F.concat_ws("|", "question", "slot"))
    given = shared_out(asked.withColumnRenamed("root", "group"), leaves.select(F.col("root").alias("group"), "name"), seed).withColumnRenamed("group", "root")
    rows = kept(given.join(leaves.select("name", "path"), "name", "left"))
    made = _wrong(rows.where("not right and name is not null"), roots, middles, totals.r, seed)
    every = rows.where("right and name is not null").select("question", "slot", "right", "root", "name", F.array_join("path", " > ").alias("option")).unionByName(made)
    whole = every.groupBy("question").agg(F.count("*").alias("c"), F.count_distinct("option").alias("d")).where((F.col("c") == OPTIONS) & (F.col("d") == OPTIONS))
    return every.join(whole.select("question"), "question", "left_semi")


def _wrong(rows: DataFrame, roots: DataFrame, middles: DataFrame, many: int, seed: str) -> DataFrame:
    """Wrong paths for the leaves of ``rows``: other middle nodes of the own root, or another root with middle nodes of its own."""
    need = "size(path) - 2"
    own = roots.select("root", F.col("no").alias("own"), F.col("m_start").alias("o_start"), F.col("m_n").alias("o_n"))
    away = roots.select(F.col("no").alias("away"), F.col("root").alias("other"), F.col("m_start").alias("a_start"), F.col("m_n").alias("a_n"))
    df = rows.join(own, "root")
    step = F.expr(f"1 + {hashed(seed, 'concat(id, chr(124), chr(119))')} % {max(many - 1, 1)}")
    df = df.withColumn("away", (F.col("own") - 1 + step) % many + 1).join(away, "away", "left")
    # places of the path's own middle nodes: as many as the path is long
    at = middles.select(F.col("name").alias("node"), "at")
    of = df.select("id", F.explode("path").alias("node")).join(at, "node").groupBy("id").agg(F.collect_list("at").alias("_path"))
    df = df.join(of, "id", "left").withColumn("_path", F.coalesce("_path", F.expr(_NO_PLACES)))
    elsewhere = (F.pmod(draw(seed, "r", F.col("id")), F.lit(100)) < OTHER_ROOT) & (F.lit(many) > 1) & F.col("a_n").isNotNull()
    few = F.coalesce(F.col("o_n") - F.size("_path"), F.lit(0)) < F.expr(need)  # too few others in the own root
    df = df.withColumn("_else", (elsewhere | few) & (F.lit(many) > 1) & F.col("a_n").isNotNull())
    df = df.withColumn("_of", F.when(F.col("_else"), ranges((F.col("a_start"), F.col("a_n")))).otherwise(ranges((F.col("o_start"), F.col("o_n")))))
    df = df.withColumn("_got", drawn("_of", "_path", need, seed, "concat('middle|', id)"))
    # another root may have fewer middle nodes than the path needs: those it has are repeated
    node = df.where("size(_got) > 0").withColumn("first", F.when(F.col("_else"), F.col("other")).otherwise(F.col("root")))
    node = node.where(F.col("_else") | (F.size("_got") == F.expr(need)))
    places = node.select("id", F.posexplode(F.expr(f"transform(sequence(0, {need} - 1), i -> get(_got, i % size(_got)))")).alias("k", "at")).join(middles.select("at", "name"), "at")
    named = places.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("_m")).select("id", F.col("_m.name").alias("_m"))
    out = node.join(named, "id")
    return out.select("question", "slot", "right", "root", "name", F.array_join(F.concat(F.array("first"), "_m", F.array("name")), " > ").alias("option"))


def a4_roots(order: DataFrame, inner: DataFrame, count: int, seed: str, used: DataFrame | None = None) -> DataFrame:
    """(id, task_type, question, text, options, correct, names): which of five paths are right, right ones from different root categories."""
    rows = paths_of_roots(order, inner, count, seed, used).withColumn("option", display_nodes(F.col("option")))
    names = rows.groupBy("question").agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = in_order(rows, ["question"], seed).join(names, "question")
    text = with_footnote(F.lit("Which of these paths are right in every node?"), F.col("options"), whole=False)
    key = F.left(F.md5(F.concat_ws("|", F.lit(seed), F.lit("A4M"), "question")), F.lit(8))
    return out.select(F.concat(F.lit("A4M_"), key).alias("id"), F.lit("A4M").alias("task_type"), "question", text.alias("text"), "options", "correct", "names")


def ancestors_of_pairs(pairs: DataFrame, order: DataFrame, fam: DataFrame, root: str, seed: str) -> DataFrame:
    """(a, b, right, tier, option): five options for each pair, as many common ancestors as the weights draw or as there are.

    All common ancestors may be drawn, the root among them. Wrong options come from the nearest tier that has some: above one of
    the two alone, then children of common ancestors, then any node of the same root categories. Pairs without
    five options give none.
    """
    of = lambda x: order.select(F.col("name").alias(x), F.col("path").alias(f"_{x}"))
    df = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").withColumn("key", F.concat_ws("|", "a", "b"))
    up = lambda x: F.slice(x, F.lit(1), F.size(x) - 1)
    by_hash = lambda xs, what: F.transform(F.array_sort(F.transform(xs, lambda x: F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), F.col("key"), x)), x))), lambda z: F.substring(z, 33, 1 << 20))
    df = df.withColumns({"common": F.array_intersect(up(F.col("_a")), up(F.col("_b"))), "alone": F.array_union(F.array_except(up(F.col("_a")), up(F.col("_b"))), F.array_except(up(F.col("_b")), up(F.col("_a"))))})
    df = df.withColumn("alone", F.array_except("alone", F.array("a", "b", F.lit(root))))
    df = df.withColumn("n", F.least(weighted(draw(seed, "n5", F.col("key")), A5_WEIGHTS), F.size("common")))
    df = df.withColumns({"_right": F.slice(by_hash(F.col("common"), "right"), F.lit(1), F.col("n")), "_one": F.slice(by_hash(F.col("alone"), "alone"), F.lit(1), OPTIONS - F.col("n"))})
    df = kept(df.withColumn("need", OPTIONS - F.size("_right") - F.size("_one")))
    # the nodes of both paths with their places, and the ranges of their parents' children; as many as the paths are long
    short = df.where("need > 0")
    nodes = short.select("key", "common", F.explode(F.array_union("_a", "_b")).alias("node"))
    at = nodes.join(fam.select(F.col("name").alias("node"), "parent", "at", "s_start", "s_n"), "node").join(order.select(F.col("name").alias("node"), "pre", F.col("n").alias("below"), "depth"), "node")
    near = F.collect_set(F.when(F.array_contains("common", F.col("parent")), F.struct(F.col("s_start").alias("start"), F.col("s_n").alias("n"))))
    cats = F.collect_set(F.when(F.col("depth") == 1, F.struct((F.col("pre") + 1).alias("start"), F.col("below").alias("n"))))
    placed = at.groupBy("key").agg(near.alias("_near"), F.collect_list("at").alias("_at"), F.filter(cats, lambda r: r["n"] > 0).alias("_cats"), F.collect_list("pre").alias("_pre"))
    short = short.join(placed, "key").withColumn("_two", drawn("_near", "_at", "need", seed, "concat('child|', key)"))
    child = kept(short.select("key", F.explode("_two").alias("at")).join(fam.select("at", "name"), "at").join(order.select("name", "pre"), "name").select("key", "name", "pre"))
    taken = child.groupBy("key").agg(F.collect_list("pre").alias("_child"))
    left = short.withColumn("rest", F.col("need") - F.size("_two")).where("rest > 0").join(taken, "key", "left").withColumn("_seen", F.concat("_pre", F.coalesce("_child", F.expr(_NO_PLACES))))
    far = left.select("key", F.explode(drawn("_cats", "_seen", "rest", seed, "concat('far|', key)")).alias("pre")).join(order.select("pre", "name"), "pre").select("key", "name")
    rows = df.select("key", F.lit(True).alias("right"), F.lit("common").alias("tier"), F.explode("_right").alias("option"))
    rows = rows.unionByName(df.select("key", F.lit(False).alias("right"), F.lit("one").alias("tier"), F.explode("_one").alias("option")))
    rows = rows.unionByName(child.select("key", F.lit(False).alias("right"), F.lit("child").alias("tier"), F.col("name").alias("option")))
    rows = rows.unionByName(far.select("key", F.lit(False).alias("right"), F.lit("far").alias("tier"), F.col("name").alias("option")))
    whole = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") == OPTIONS).select("key")
    return df.select("key", "a", "b").join(rows.join(whole, "key", "left_semi"), "key").drop("key")


def a5_pairs(h, each: int, seed: str, used_pairs: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """(id, task_type, a, b, text, options, correct): which of five are above both of a deep pair; pairs and descriptors used before take no part."""
    order, fam = preorder(h), family(h)
    pairs = deep_pairs(h, order, each, seed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if used_pairs is not None:
        pairs = pairs.join(used_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    if used is not None:
        pairs = pairs.join(used.select(F.col("name").alias("a")), "a", "left_anti").join(used.select(F.col("name").alias("b")), "b", "left_anti")
    rows = ancestors_of_pairs(pairs, order, fam, h.root, seed).withColumn("option", display_nodes(F.col("option")))
    out = in_order(rows, ["a", "b"], seed)
    text = with_footnote(F.concat(F.lit("Which are above both '"), "a", F.lit("' and '"), "b", F.lit("'?")), F.col("options"))
    return out.select(F.concat(F.lit("A5M_"), F.left(F.md5(F.concat_ws("|", F.lit(seed), "a", "b")), F.lit(8))).alias("id"), F.lit("A5M").alias("task_type"), "a", "b", text.alias("text"), "options", "correct")
