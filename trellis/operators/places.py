"""Places instead of pools: nodes are numbered so that a pool is a few ranges of numbers, and a drawn number is an equi-join.

``family`` numbers nodes by grandparent, parent and name: the children of a node are one range, and so are its
grandchildren. ``preorder`` numbers them by their path: all descendants of a node are one range. Both numberings are made
by ranges of the order, so no task holds all nodes, nor all children of one. Siblings, cousins, uncles, descendants and
strangers of a node are then ranges with a gap, known from a few numbers in its row, however many they are; pairs of
descendants are numbered by arithmetic. No pool is gathered and no pair of nodes is made that isn't drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import kept
from .hierarchy import Hierarchy
from .ordering import numbered

RANGES = "array<struct<start:bigint,n:bigint>>"


def hashed(seed: str, key: str) -> str:
    """SQL of a number below 2^60 from the hash of the seed and ``key``, an SQL string."""
    return f"cast(conv(left(md5(concat('{seed}|', {key})), 15), 16, 10) as bigint)"


def ranges(*each: tuple[Column, Column]) -> Column:
    """Ranges of places from (first, how many); empty and unknown ones go. Ranges must not overlap."""
    made = F.array(*(F.struct(a.cast("long").alias("start"), n.cast("long").alias("n")) for a, n in each))
    return F.filter(made, lambda r: F.coalesce(r["n"] > 0, F.lit(False)))


def drawn(of: str, without: str, k: str, seed: str, key: str) -> Column:
    """At most ``k`` different places, all equally likely, of the ranges in the column ``of`` and not in the column ``without``.

    ``k`` and ``key`` are SQL; the key tells draws apart. Places of ``without`` that are in no range count for nothing. The
    j-th number is drawn from what is left and moved past the places that are taken, so the work is that of k and of
    ``without``, whatever the ranges hold.
    """
    at = f"aggregate({of}, named_struct('off', 0L, 'hit', -1L), (t, r) -> named_struct('off', t.off + r.n, 'hit', if(p >= r.start and p < r.start + r.n, t.off + p - r.start, t.hit)), t -> t.hit)"
    place = f"aggregate({of}, named_struct('off', 0L, 'at', -1L), (t, r) -> named_struct('off', t.off + r.n, 'at', if(x >= t.off and x < t.off + r.n, r.start + x - t.off, t.at)), t -> t.at)"
    taken = f"array_sort(array_distinct(filter(transform({without}, p -> {at}), y -> y >= 0)))"
    left = f"(aggregate({of}, 0L, (t, r) -> t + r.n) - size(taken))"
    step = f"aggregate(a.taken, {hashed(seed, f'concat({key}, chr(124), j)')} % (s.left - j), (x, y) -> if(x >= y, x + 1, x))"
    return F.expr(f"""element_at(transform(transform(array({taken}), taken -> named_struct('taken', taken, 'left', {left})), s ->
        if(least(cast({k} as bigint), s.left) > 0,
           aggregate(sequence(0L, least(cast({k} as bigint), s.left) - 1), named_struct('taken', s.taken, 'got', cast(array() as array<bigint>)),
               (a, j) -> element_at(transform(array({step}), z -> named_struct('taken', array_sort(array_append(a.taken, z)), 'got', array_append(a.got, z))), 1),
               a -> transform(a.got, x -> {place})),
           cast(array() as array<bigint>))), 1)""")


def _blocks(rows: DataFrame, by: str, at: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min(at).alias(f"{name}_start"), F.count("*").alias(f"{name}_n"))


def family(h: Hierarchy) -> DataFrame:
    """(name, parent, grand, at, s_start, s_n, c_start, c_n, u_at, u_start, u_n), for every node with a parent.

    ``at`` is the place by grandparent, parent and name, from 1. The children of the parent (s) and those of its siblings
    and itself (c) are ranges of places, as are the siblings of the parent and itself (u), who is at u_at; null where there
    is no grandparent. Written once; a node with several parents counts with its first.
    """
    f = h.first_parent().where("name <> parent")
    up = f.select(F.col("name").alias("parent"), F.col("parent").alias("grand"))
    rows = kept(numbered(f.join(up, "parent", "left"), ["grand", "parent", "name"], "at"))
    df = rows.join(_blocks(rows, "parent", "at", "s"), "parent").join(_blocks(rows.where("grand is not null"), "grand", "at", "c"), "grand", "left")
    over = rows.select(F.col("name").alias("parent"), F.col("parent").alias("grand"), F.col("at").alias("u_at")).join(_blocks(rows, "parent", "at", "u").withColumnRenamed("parent", "grand"), "grand")
    return kept(df.join(over.drop("grand"), "parent", "left").select("name", "parent", "grand", "at", "s_start", "s_n", "c_start", "c_n", "u_at", "u_start", "u_n"))


def preorder(h: Hierarchy) -> DataFrame:
    """(name, pre, n, depth, path) of every node that hangs from the root, the root among them.

    ``pre`` is the place by path, from 1; the ``n`` descendants of a node are the places after its own. ``path`` begins at
    the root; nodes on or below a cycle don't hang from it and take no part.
    """
    chain = h.chain_with_self()
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ancestor"))), lambda x: x["ancestor"])  # as long as the node is deep
    rows = chain.groupBy("name").agg(path.alias("path")).where(F.get("path", F.lit(0)) == h.root)
    many = chain.where("dist > 0").groupBy(F.col("ancestor").alias("name")).agg(F.count("*").alias("n"))
    rows = numbered(rows.withColumn("depth", F.size("path") - 1), ["path"], "pre")
    return kept(rows.join(many, "name", "left").select("name", "pre", F.coalesce("n", F.lit(0)).alias("n"), "depth", "path"))


TIERS = ("cousin", "uncle", "unrelated")


def non_siblings(of: DataFrame, fam: DataFrame, count: int, seed: str) -> DataFrame:
    """(name, tier, k, other): ``count`` nodes that are no siblings of each ``name``, from the nearest tier that has some.

    Children of the parent's siblings come first, then the parent's siblings, then any node that is no sibling and not
    the parent or the root; a later tier gives what the earlier ones lack. Fewer only if the whole hierarchy has no more.
    """
    c = F.col
    df = of.select("name").distinct().join(fam, "name")
    total = fam.agg(F.max("at").alias("m")).first().m or 0
    end = c("s_start") + c("s_n")
    df = df.withColumns(
        {
            "_r0": ranges((c("c_start"), c("s_start") - c("c_start")), (end, c("c_start") + c("c_n") - end)),
            "_r1": ranges((c("u_start"), c("u_at") - c("u_start")), (c("u_at") + 1, c("u_start") + c("u_n") - c("u_at") - 1)),
            "_r2": ranges((F.lit(1), c("s_start") - 1), (end, F.lit(total) - end + 1)),
            "_none": F.expr("cast(array() as array<bigint>)"),
        }
    )
    df = df.withColumn("_t0", drawn("_r0", "_none", str(count), seed, "concat('cousin|', name)"))
    df = df.withColumn("_t1", drawn("_r1", "_none", f"{count} - size(_t0)", seed, "concat('uncle|', name)"))
    df = df.withColumn("_seen", F.concat("_t0", "_t1", F.when(c("u_at").isNotNull(), F.array("u_at")).otherwise(c("_none"))))
    df = df.withColumn("_t2", drawn("_r2", "_seen", f"{count} - size(_t0) - size(_t1)", seed, "concat('unrelated|', name)"))
    each = F.expr("concat(" + ", ".join(f"transform(_t{i}, x -> named_struct('tier', '{t}', 'at', x))" for i, t in enumerate(TIERS)) + ")")
    rows = df.select("name", F.posexplode(each).alias("k", "x")).select("name", F.col("x.tier").alias("tier"), "k", F.col("x.at").alias("at"))
    return rows.join(fam.select(F.col("name").alias("other"), "at"), "at").select("name", "tier", "k", "other")


def pair_of(r: str) -> tuple[str, str]:
    """SQL of (i, j), i < j, of the r-th pair when pairs are counted by j, then i; exact below 2^62.

    The root of a double is at most one off, which a comparison of whole numbers sets right.
    """
    guess = f"cast(floor((1 + sqrt(1 + 8D * {r})) / 2) as bigint)"
    j = f"element_at(transform(array({guess}), g -> if(g * (g - 1) div 2 > {r}, g - 1, if((g + 1) * g div 2 <= {r}, g + 1, g))), 1)"
    return f"({r} - ({j}) * (({j}) - 1) div 2)", f"({j})"


def deep_pairs(h: Hierarchy, order: DataFrame, each: int, seed: str, least_depth: int = 2) -> DataFrame:
    """(node, k, a, b): ``each`` different pairs of descendants of every node of at least ``least_depth`` that has two.

    Such pairs share an ancestor that is neither the root nor a root category. All pairs of a node's n descendants are
    numbered; a drawn number gives two places in ``order`` (see ``preorder``), so no pair is made that isn't drawn.
    A node with fewer pairs gives them all. ``a`` comes before ``b`` in the order.
    """
    df = order.where((F.col("depth") >= least_depth) & (F.col("n") >= 2)).select(F.col("name").alias("node"), "pre", "n")
    df = df.withColumns({"_of": ranges((F.lit(0), F.expr("n * (n - 1) div 2"))), "_none": F.expr("cast(array() as array<bigint>)")})
    df = df.select("node", "pre", F.posexplode(drawn("_of", "_none", str(each), seed, "concat('pair|', node)")).alias("k", "r"))
    i, j = pair_of("r")
    df = df.select("node", "k", (F.col("pre") + 1 + F.expr(i)).alias("pa"), (F.col("pre") + 1 + F.expr(j)).alias("pb"))
    at = order.select(F.col("pre").alias("pa"), F.col("name").alias("a"))
    return df.join(at, "pa").join(at.withColumnRenamed("pa", "pb").withColumnRenamed("a", "b"), "pb").select("node", "k", "a", "b")
