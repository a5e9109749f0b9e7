"""Question generation from a hierarchy, set-oriented and reproducible.

Every choice is a place in a pool (the children of a node), by the hash of a seed, what is chosen and the descriptor: pools are numbered once,
a chosen place is an equi-join, and no pool is crossed with the descriptors. The same seed gives the same bank on
any cluster. What a row of each type must satisfy holds for every row; rows for which a pool is too small are not
made. ``limited`` keeps a number of rows by hash, and ``unused`` leaves out what earlier runs used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DISPLAYED, FOOTNOTE, display_nodes, squashed, words
from .hierarchy import Hierarchy
from .ordering import numbered_in
from .places import drawn, non_siblings, ranges

# Weights of the number of right options.
A4_WEIGHTS = [11, 33, 33, 11, 7, 4]
A5_WEIGHTS = [5, 25, 40, 20, 7, 3]
NEVER_REUSED = 3
# Wordings of reference answers.
CLASSIFIED = "Hierarchically, it is classified as: "
SHARED = "They share a common ancestor: "
DISTANCE = ("The graph distance between them is ", " levels")
NEARNESS = [(2, "suggesting they are relatively similar"), (4, "suggesting they are moderately related"), (None, "suggesting they are quite distinct")]


def draw(seed: str, what: str, *keys: Column) -> Column:
    """A number below 2^32 from the hash of the seed, what it is for, and the keys."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), *keys)), F.lit(8)), 16, 10).cast("long")


def weighted(number: Column, weights: list[int]) -> Column:
    """0, 1, ... with the given weights, from a number."""
    at, out, total = F.pmod(number, F.lit(sum(weights))), F.lit(len(weights) - 1), 0
    cuts = []
    for i, w in enumerate(weights[:-1]):
        total += w
        cuts.append((i, total))
    for i, c in reversed(cuts):
        out = F.when(at < c, i).otherwise(out)
    return out


def pool(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, idx, member, n): members numbered from 0 in each group, by name; n is the group's size."""
    return numbered_in(members.select(group, member).distinct(), group, [member], "idx", "n").select(group, "idx", member, "n")


def picks(h: Hierarchy, seed: str, of: DataFrame | None = None) -> DataFrame:
    """For every leaf below the root, or every node of ``of`` (name) that has a parent: where it stands, its relatives and strangers.

    (name, parent, grand, top, path, s0-s2 siblings, u0-u2 siblings of the parent, c0-c2 their children, w another top
    category, v a child of it, f a child of that); ``top`` is the root category above or the leaf itself, ``path`` the
    chain from it to the leaf. Null where there is no such node.
    """
    first = h.first_parent()
    kids = pool(first.select(F.col("parent").alias("p"), F.col("name").alias("k")), "p", "k")
    chain = h.chain_with_self().where(F.col("ancestor") != h.root).groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ancestor"))).alias("_c"))  # a chain
    base = first.join(h.leaves() if of is None else of.select("name"), "name", "left_semi").join(first.select(F.col("name").alias("parent"), F.col("parent").alias("grand")), "parent", "left")
    base = base.join(chain.select("name", F.col("_c.ancestor").alias("path")), "name").withColumn("top", F.get("path", F.lit(0)))

    def own_place(df: DataFrame, node: str, tag: str) -> DataFrame:
        return df.join(kids.select(F.col("k").alias(node), F.col("idx").alias(f"{tag}_i"), F.col("n").alias(f"{tag}_n"), F.col("p").alias(f"{tag}_p")), node, "left")

    def beside(df: DataFrame, tag: str, j: int, out: str, step: Column) -> DataFrame:
        n, i = F.col(f"{tag}_n"), F.col(f"{tag}_i")
        place = F.when(n > j + 1, F.pmod(i + 1 + F.pmod(step + j, F.greatest(n - 1, F.lit(1))), n))
        return df.withColumn("_at", place).join(kids.select(F.col("p").alias(f"{tag}_p"), F.col("idx").alias("_at"), F.col("k").alias(out)), [f"{tag}_p", "_at"], "left").drop("_at")

    def child_of(df: DataFrame, node: str, out: str, number: Column) -> DataFrame:
        many = kids.groupBy("p").agg(F.first("n").alias("_n")).withColumnRenamed("p", node)
        placed = df.join(many, node, "left").withColumn("_at", F.pmod(number, F.col("_n")))
        return placed.join(kids.select(F.col("p").alias(node), F.col("idx").alias("_at"), F.col("k").alias(out)), [node, "_at"], "left").drop("_at", "_n")

    name = F.col("name")
    df = own_place(own_place(own_place(base, "name", "s"), "parent", "u"), "top", "w")
    for j in range(3):
        df = beside(df, "s", j, f"s{j}", draw(seed, "s", name))
        df = beside(df, "u", j, f"u{j}", draw(seed, "u", name))
        df = child_of(df, f"u{j}", f"c{j}", draw(seed, f"c{j}", name))
    df = beside(df, "w", 0, "w", draw(seed, "w", name))
    df = child_of(df, "w", "v", draw(seed, "v", name))
    df = child_of(df, "v", "f", draw(seed, "f", name))
    return df.select("name", "parent", "grand", "top", "path", *(f"{t}{j}" for t in "suc" for j in range(3)), "w", "v", "f")


def assembled(df: DataFrame, seed: str, task: str, text: Column, right: Column, wrong: Column) -> DataFrame:
    """(id, task_type, name, text, options, correct): options in an order by hash, letters of the right ones; rows with a null or repeated option go."""
    every = F.concat(right, wrong)
    out = df.withColumn("_r", right).withColumn("_o", every).where(~F.exists("_o", lambda o: o.isNull()) & (F.size("_o") == F.size(F.array_distinct("_o"))))
    keyed = F.array_sort(F.transform("_o", lambda o: F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.lit(task), F.col("name"), o)), o)))
    out = out.withColumn("options", F.transform(keyed, lambda z: F.substring(z, 33, 1 << 20)))
    letters = F.array_compact(F.transform("options", lambda o, i: F.when(F.array_contains("_r", o), F.char(i + 65))))
    return out.select(
        F.concat(F.lit(f"{task}_"), F.left(F.md5(F.concat_ws("|", F.lit(seed), F.lit(task), "name")), F.lit(8))).alias("id"),
        F.lit(task).alias("task_type"), "name", text.alias("text"), "options", F.array_join(letters, ",").alias("correct"),
    )


#: Tasks whose texts explain ``other``, and those that name their descriptor as it is displayed.
EXPLAINED, NAMED = ("A1", "E1", "E2", "E3"), ("E1", "E2")


def displayed(questions: DataFrame) -> DataFrame:
    """Questions (task_type, name, text, options, ...) as they are shown: nodes by their displayed names, and a footnote where ``other`` is among them.

    In rankings and paths each node is looked at; a null text or list of options stays null.
    """
    old, new = DISPLAYED
    task = F.split_part("task_type", F.lit("_"), F.lit(1))
    own = task.isin(*NAMED) & (F.col("name") == old)
    shown = F.transform("options", display_nodes)
    nodes = F.flatten(F.transform(shown, lambda o: F.split(o, " > ")))
    has = task.isin(*EXPLAINED) & (F.array_contains(nodes, new) | own)
    text = F.when(own, F.replace("text", F.lit(f"'{old}'"), F.lit(f"'{new}'"))).otherwise(F.col("text"))
    return questions.withColumns({"text": F.concat(text, F.when(F.coalesce(has, F.lit(False)), FOOTNOTE).otherwise("")), "options": shown})


def limited(questions: DataFrame, count: int, seed: str) -> DataFrame:
    return questions.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "name")), "name").limit(count)


def unused(questions: DataFrame, used: DataFrame, most: int = NEVER_REUSED) -> DataFrame:
    """Questions whose descriptor is in fewer than ``most`` rows of ``used`` (name)."""
    return questions.join(used.groupBy("name").count().where(F.col("count") >= most).select("name"), "name", "left_anti")


def _whole(sep: str, *nodes: Column) -> Column:
    """Nodes joined; null if one is null."""
    out = nodes[0]
    for n in nodes[1:]:
        out = F.concat(out, F.lit(sep), n)
    return out


def a1(p: DataFrame, h: Hierarchy, seed: str) -> DataFrame:
    """To which root categories a descriptor belongs; all that its parents lead to are right, other roots by hash are wrong."""
    roots = h.root_categories().agg(F.array_sort(F.collect_set("name")).alias("_all"))  # one row: the root categories
    df = p.join(h.root_categories_of_parents(), "name").crossJoin(F.broadcast(roots))
    others = F.slice(F.array_sort(F.transform(F.array_except("_all", "categories"), lambda r: F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.lit("root"), F.col("name"), r)), r))), 1, 5)
    return assembled(df, seed, "A1", F.concat(F.lit("Which categories hold '"), "name", F.lit("'?")), F.col("categories"), F.transform(others, lambda z: F.substring(z, 33, 1 << 20)))


def a2(p: DataFrame, seed: str) -> DataFrame:
    """Whether a node is above a descriptor: half the claims are true; a false one names a middle node of another root category."""
    true = F.pmod(draw(seed, "a2", F.col("name")), F.lit(2)) == 0
    parent = (F.pmod(draw(seed, "up", F.col("name")), F.lit(2)) == 0) | (F.col("top") == F.col("name"))
    above = F.when(true, F.when(parent, F.col("parent")).otherwise(F.col("top"))).otherwise(F.col("v"))
    text = F.concat(F.lit("Is '"), above, F.lit("' above '"), "name", F.lit("'?"))
    return assembled(p.where(above.isNotNull()), seed, "A2", text, F.array(F.when(true, "Yes").otherwise("No")), F.array(F.when(true, "No").otherwise("Yes")))


def a3(p: DataFrame, seed: str) -> DataFrame:
    """Which is a sibling: one is, three are children of the parent's siblings."""
    return assembled(p, seed, "A3", F.concat(F.lit("Which is a sibling of '"), "name", F.lit("'?")), F.array("s0"), F.array("c0", "c1", "c2"))


def a3_tiers(fam: DataFrame, seed: str) -> DataFrame:
    """``a3`` for every node of a ``family`` table that has a sibling: wrong options are cousins, then siblings of the parent, then strangers."""
    df = fam.where("s_n > 1").withColumns({"_of": ranges((F.col("s_start"), F.col("s_n"))), "_own": F.array("at")})
    one = df.select("name", F.get(drawn("_of", "_own", "1", seed, "concat('sibling|', name)"), F.lit(0)).alias("at")).join(fam.select(F.col("name").alias("s0"), "at"), "at")
    wrong = non_siblings(df, fam, 3, seed).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "other"))).alias("_w"))  # three for each node
    rows = one.join(wrong, "name").where("size(_w) = 3")
    return assembled(rows, seed, "A3", F.concat(F.lit("Which is a sibling of '"), "name", F.lit("'?")), F.array("s0"), F.transform("_w", lambda x: x["other"]))


def _joined(sep: str, *parts: Column) -> Column:
    """Arrays of nodes as one path; null if a node is null."""
    whole = F.concat(*parts)
    return F.when(~F.exists(whole, lambda x: x.isNull()), F.array_join(whole, sep))


def _upper(less: int) -> Column:
    """The path without its last ``less`` nodes."""
    return F.slice("path", F.lit(1), F.greatest(F.size("path") - less, F.lit(0)))


def a4(p: DataFrame, seed: str) -> DataFrame:
    """Which path leads to a descriptor, from its root category on: wrong ones have another root, another middle, or another order."""
    c, sep = F.col, " → "
    below = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    turned = F.when(F.size("path") > 2, F.concat(F.reverse(_upper(1)), F.array("name"))).otherwise(F.reverse("path"))
    wrong = F.array(_joined(sep, F.array("w"), below), _joined(sep, F.when(F.size("path") > 2, _upper(2)).otherwise(F.array("top")), F.array("v", "name")), _joined(sep, turned))
    return assembled(p.where(F.size("path") > 1), seed, "A4", F.concat(F.lit("Which path leads to '"), "name", F.lit("'?")), F.array(_joined(sep, c("path"))), wrong)


def a5(p: DataFrame, seed: str) -> DataFrame:
    """The nearest common ancestor of a descriptor and a cousin: wrong are an ancestor of one, one of the other, and an unrelated node."""
    return assembled(p.where("c0 is not null"), seed, "A5", F.concat(F.lit("What joins '"), "name", F.lit("' and '"), "c0", F.lit("'?")), F.array("grand"), F.array("parent", "u0", "v"))


def e1(p: DataFrame, seed: str) -> DataFrame:
    """Rank a sibling, a cousin and a stranger by distance; wrong are three of the other five orders, by hash."""
    c = [F.col(x) for x in ("s0", "c0", "f")]
    orders = [(0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    every = F.array(*(_whole(" > ", *(c[i] for i in o)) for o in orders))
    chosen = F.slice(F.array_sort(F.transform(every, lambda r: F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.lit("rank"), F.col("name"), r)), r))), 1, 3)
    return assembled(p.where("s0 is not null and c0 is not null and f is not null"), seed, "E1", F.concat(F.lit("Rank by likeness to '"), "name", F.lit("'.")), F.array(_whole(" > ", *c)), F.transform(chosen, lambda z: F.substring(z, 33, 1 << 20)))


def e2(p: DataFrame, seed: str) -> DataFrame:
    """Which of three is nearest: the next is at least two hops further."""
    return assembled(p, seed, "E2", F.concat(F.lit("Which is nearest to '"), "name", F.lit("'?")), F.array("s0"), F.array("c0", "f"))


def near_duplicates(names: Column) -> Column:
    """Whether one of the names, squashed, begins with another."""
    s = F.transform(names, squashed)
    return F.exists(F.transform(s, lambda x, i: F.exists(F.transform(s, lambda y, j: (i != j) & y.startswith(x)), lambda b: b)), lambda b: b)


def common_word(names: Column) -> Column:
    """Whether a word of at least three letters is in every name."""
    low = F.transform(names, F.lower)
    every = F.array_distinct(F.flatten(F.transform(low, words)))
    return F.exists(F.filter(every, lambda w: F.char_length(w) >= 3), lambda w: F.forall(low, lambda n: n.contains(w)))


def e3(p: DataFrame, seed: str) -> DataFrame:
    """The odd one out: three siblings and a stranger from another root; names that give it away are not used."""
    same = F.array("name", "s0", "s1")
    ok = p.where("s0 is not null and s1 is not null and f is not null").where(
        ~near_duplicates(same) & ~common_word(same) & ~near_duplicates(F.concat(same, F.array("f"))) & ~F.exists(same, lambda x: F.arrays_overlap(words(x), words(F.col("f"))))
    )
    return assembled(ok, seed, "E3", F.lit("Which does not belong?"), F.array("f"), same)


def f_single(p: DataFrame) -> DataFrame:
    """(id, task_type, name, text, reference): what a descriptor is, and where it stands."""
    ref = F.concat(F.lit("'"), "name", F.lit("' is a descriptor. " + CLASSIFIED), F.array_join("path", " → "))
    return p.select(F.concat(F.lit("F_"), F.left(F.md5(F.concat_ws("|", F.lit("F"), "name")), F.lit(8))).alias("id"), F.lit("F").alias("task_type"), "name", F.concat(F.lit("Describe '"), "name", F.lit("'.")).alias("text"), ref.alias("reference"))


def f_pair(pairs: DataFrame) -> DataFrame:
    """Of (a, b, lca, hops): what two descriptors share and how far apart they are, in words by distance."""
    far = F.lit(NEARNESS[-1][1])
    for most, wording in reversed(NEARNESS[:-1]):
        far = F.when(F.col("hops") <= most, wording).otherwise(far)
    ref = F.concat_ws(" ", F.concat(F.lit("Comparing '"), "a", F.lit("' and '"), "b", F.lit("':")), F.when(F.col("lca").isNotNull(), F.concat(F.lit(SHARED + "'"), "lca", F.lit("'"))),
        F.when(F.col("hops") > 0, F.concat(F.lit(DISTANCE[0]), F.col("hops").cast("string"), F.lit(DISTANCE[1]))), F.when(F.col("hops") > 0, far))
    return pairs.select("a", "b", ref.alias("reference"))


def f_category(h: Hierarchy) -> DataFrame:
    """(name, reference): what a root category holds; the first five children by name, and how many more."""
    kids = h.edges.join(h.root_categories().withColumnRenamed("name", "source"), "source").groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("k"))
    more = F.when(F.size("k") > 5, F.concat(F.lit(" and "), (F.size("k") - 5).cast("string"), F.lit(" others"))).otherwise("")
    return kids.select(F.col("source").alias("name"), F.concat(F.lit("'"), "source", F.lit("' is a root category. It encompasses: "), F.array_join(F.slice("k", 1, 5), ", "), more).alias("reference"))


def a4_multi(p: DataFrame, h: Hierarchy, seed: str) -> DataFrame:
    """Which of five paths are right: as many as the weights draw; a wrong one has another root (3 of 10) or another middle."""
    n = weighted(draw(seed, "n4", F.col("name")), A4_WEIGHTS)
    base = p.where("w is not null and v is not null and c0 is not null and c1 is not null and s0 is not null and f is not null and size(path) > 1").withColumn("_n", n)
    # each leaf with the nodes above it: those above its parent, and the parent
    leaves = [("name", _upper(2), "parent"), ("s0", _upper(2), "parent"), ("c0", _upper(2), "u0"), ("c1", _upper(2), "u1"), ("f", F.array("w"), "v")]
    paths = []
    for k, (leaf, upper, mid) in enumerate(leaves):
        other_top, other_mid = ("top", "parent") if leaf == "f" else ("w", "v")
        good = F.concat(upper, F.array(mid, leaf))
        wrong_root = F.pmod(draw(seed, f"r{k}", F.col("name")), F.lit(10)) < 3
        lower = F.slice(good, F.lit(2), F.greatest(F.size(good) - 1, F.lit(0)))
        bad = F.when(wrong_root, _joined(" > ", F.array(other_top), lower)).otherwise(_joined(" > ", upper, F.array(other_mid, leaf)))
        paths.append(F.struct((F.lit(k) < F.col("_n")).alias("ok"), F.when(F.lit(k) < F.col("_n"), _joined(" > ", good)).otherwise(bad).alias("path")))
    both = F.array(*paths)
    right = F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["path"])
    wrong = F.transform(F.filter(both, lambda x: ~x["ok"]), lambda x: x["path"])
    return assembled(base, seed, "A4M", F.lit("Which paths are right?"), right, wrong)


def a5_multi(p: DataFrame, root: str, seed: str) -> DataFrame:
    """Which of five are common ancestors of a descriptor and a sibling, the root among them: as many as the weights draw, or as there are; wrong ones by tiers."""
    name = F.col("name")
    common = F.concat(F.reverse(_upper(1)), F.array(F.lit(root)))  # of siblings: all that is above one
    n = F.least(weighted(draw(seed, "n5", name), A5_WEIGHTS), F.size(common))
    by_hash = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.lit("v"), name, x)), x))), lambda z: F.substring(z, 33, 1 << 20))
    base = p.where("s0 is not null and u0 is not null and u1 is not null and u2 is not null and v is not null and w is not null").withColumn("_n", n)
    right = F.slice(by_hash(common), F.lit(1), F.col("_n"))
    wrong = F.slice(F.array("u0", "u1", "u2", "w", "v"), F.lit(1), 5 - F.col("_n"))
    return assembled(base, seed, "A5M", F.concat(F.lit("Which are above both '"), "name", F.lit("' and '"), "s0", F.lit("'?")), right, wrong)


def bank(h: Hierarchy, seed: str) -> dict[str, DataFrame]:
    """All types by name."""
    p = picks(h, seed)
    return {"A1": a1(p, h, seed), "A2": a2(p, seed), "A3": a3(p, seed), "A4": a4(p, seed), "A5": a5(p, seed), "E1": e1(p, seed), "E2": e2(p, seed), "E3": e3(p, seed), "A4M": a4_multi(p, h, seed), "A5M": a5_multi(p, h.root, seed)}


def of_type(h: Hierarchy, task: str, seed: str) -> DataFrame:
    found = bank(h, seed)
    key = task.split("_")[0].upper()
    if key not in found:
        raise ValueError(f"no task type begins with {key!r}; there are {sorted(found)}")
    return found[key]
