"""Queries that draw descriptors, pairs and paths by place, under limits over a whole run.

Where every possible pick would make an oracle of its own, the SQL states what must hold of whatever is picked: how many
rows each kind gives, from the sizes of pools alone, and that none breaks a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drawing, generate, multi, places
from ..operators.hierarchy import Hierarchy
from ..sources.tables import ROOT, read
from ..steps import kept
from .graph import dag, tree
from .questions import SEED, _beside, _case, _child, _draw, _hashed, _out, _sql
from .registry import query

EACH, PATHS_FOR = 3, 25


def _number(key: str) -> str:
    return f"('0x' || left(md5('{SEED}|' || {key}), 15))::BIGINT"


# --- distractors by tiers ----------------------------------------------------------------------------------------------

_TIERS = """, n AS (SELECT f.name, f.parent, g.parent AS grand FROM dag_first f LEFT JOIN dag_first g ON g.name = f.parent),
    s AS (SELECT parent, count(*) AS k FROM n GROUP BY ALL), c AS (SELECT grand, count(*) AS k FROM n WHERE grand IS NOT NULL GROUP BY ALL),
    x AS (SELECT n.name, s.k AS family, coalesce(c.k - s.k, 0) AS cousins, coalesce(u.k - 1, 0) AS uncles, (SELECT count(*) FROM n) - s.k - CASE WHEN n.grand IS NULL THEN 0 ELSE 1 END AS others
      FROM n JOIN s ON s.parent = n.parent LEFT JOIN c ON c.grand = n.grand LEFT JOIN s u ON u.parent = n.grand),
    t AS (SELECT name, family, others, least(cousins, 3) AS t0, least(uncles, 3 - least(cousins, 3)) AS t1 FROM x)"""


@query(_TIERS + " SELECT name, t0 AS n_cousin, t1 AS n_uncle, greatest(least(others - t0 - t1, 3 - t0 - t1), 0) AS n_unrelated, 0::BIGINT AS n_wrong, t0 + t1 + greatest(least(others - t0 - t1, 3 - t0 - t1), 0) AS n_different FROM t", "dag_first")
def non_sibling_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Q04, Q09: three nodes for every node that are no siblings of it; how many each tier gives, and how many don't belong there."""
    h = dag(spark, d)
    fam = places.family(h)
    got = places.non_siblings(fam, fam, 3, SEED)
    up = h.first_parent().join(h.first_parent().select(F.col("name").alias("parent"), F.col("parent").alias("grand")), "parent", "left")
    both = got.join(up.select("name", "parent", "grand"), "name").join(up.select(F.col("name").alias("other"), F.col("parent").alias("o_parent"), F.col("grand").alias("o_grand")), "other")
    away = F.col("o_parent") != F.col("parent")
    right = F.when(F.col("tier") == "cousin", away & F.col("o_grand").eqNullSafe(F.col("grand"))).when(F.col("tier") == "uncle", (F.col("o_parent") == F.col("grand")) & (F.col("other") != F.col("parent"))).otherwise(away & (F.col("other") != F.col("parent")))
    many = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in places.TIERS]
    rows = both.groupBy("name").agg(*many, F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong"), F.count_distinct("other").alias("n_different"))
    return fam.select("name").join(rows, "name", "left").fillna(0)


@query(_TIERS + ", a AS (SELECT * FROM t WHERE family > 1 AND others >= 3) SELECT name, 4 AS n_options, 1 AS n_siblings, 'true' AS right_is_sibling FROM a", "dag_first")
def gen_a3_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Q04, Q09: a question of which is a sibling for every node that has one, middle nodes among them; none is lost for want of cousins."""
    h = dag(spark, d)
    made = generate.a3_tiers(places.family(h), SEED)
    first = h.first_parent()
    each = made.select("name", "correct", F.posexplode("options").alias("k", "other")).join(first, "name").join(first.select(F.col("name").alias("other"), F.col("parent").alias("o_parent")), "other")
    sibling = F.col("parent") == F.col("o_parent")
    rows = each.groupBy("name").agg(F.count("*").cast("int").alias("n_options"), F.count_if(sibling).cast("int").alias("n_siblings"), F.bool_or(sibling & (F.char(F.col("k") + 65) == F.col("correct"))).alias("r"))
    return rows.select("name", "n_options", "n_siblings", F.col("r").cast("string").alias("right_is_sibling"))


# --- deep pairs --------------------------------------------------------------------------------------------------------

_DEEP = f""", p AS (SELECT name, list_append(list(ancestor ORDER BY dist DESC), name) AS path, count(*) AS depth FROM dag_chain GROUP BY name),
    d AS (SELECT c.ancestor AS node, c.name, row_number() OVER (PARTITION BY c.ancestor ORDER BY p.path) AS i, count(*) OVER (PARTITION BY c.ancestor) AS n
      FROM dag_chain c JOIN p ON p.name = c.name JOIN p v ON v.name = c.ancestor WHERE v.depth >= 2),
    e AS (SELECT x.node, x.name AS a, y.name AS b, row_number() OVER (PARTITION BY x.node ORDER BY y.i, x.i) - 1 AS r, x.n * (x.n - 1) // 2 AS m FROM d x JOIN d y ON x.node = y.node AND x.i < y.i),
    h0 AS (SELECT node, m, {_number("'pair|' || node || '|0'")} % m AS r0, {_number("'pair|' || node || '|1'")} % greatest(m - 1, 1) AS x1, {_number("'pair|' || node || '|2'")} % greatest(m - 2, 1) AS x2 FROM (SELECT DISTINCT node, m FROM e)),
    h1 AS (SELECT *, x1 + CASE WHEN x1 >= r0 THEN 1 ELSE 0 END AS r1 FROM h0),
    h2 AS (SELECT *, x2 + CASE WHEN x2 >= least(r0, r1) THEN 1 ELSE 0 END AS y2 FROM h1),
    h3 AS (SELECT node, r0 AS r, 0 AS k FROM h2 UNION ALL SELECT node, r1, 1 FROM h2 WHERE m > 1 UNION ALL SELECT node, y2 + CASE WHEN y2 >= greatest(r0, r1) THEN 1 ELSE 0 END, 2 FROM h2 WHERE m > 2),
    deep AS (SELECT e.node, h3.k, e.a, e.b FROM e JOIN h3 ON h3.node = e.node AND h3.r = e.r)"""


@query(_DEEP + " SELECT node, k, a, b, (SELECT max(v.depth) FROM dag_chain x JOIN dag_chain y ON y.name = deep.b AND y.ancestor = x.ancestor JOIN p v ON v.name = x.ancestor WHERE x.name = deep.a) AS lca_depth FROM deep", "dag_chain")
def deep_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Q24: three pairs of descendants of every node below the root categories that has two, unranked from hash numbers; their common ancestor's depth."""
    h = dag(spark, d)
    order = places.preorder(h)
    got = places.deep_pairs(h, order, EACH, SEED)
    depth = order.select(F.col("name").alias("lca"), F.col("depth").cast("long").alias("lca_depth"))
    return got.join(h.lca(got.select("a", "b").distinct()), ["a", "b"]).join(depth, "lca").select("node", "k", "a", "b", "lca_depth")


_A5 = f"""{_DEEP}, w AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM deep), c AS (SELECT w.a, w.b, count(*) AS m FROM w JOIN dag_chain x ON x.name = w.a JOIN dag_chain y ON y.name = w.b AND y.ancestor = x.ancestor GROUP BY ALL),
    z AS (SELECT least({_case(_draw("n5", "a || '|' || b"), generate.A5_WEIGHTS)}, m) AS n_right FROM c)
    SELECT n_right, count(*) AS questions, n_right * count(*) AS right_common, 0::BIGINT AS wrong_common, 5 * count(*) AS options, 0::BIGINT AS own_names FROM z GROUP BY n_right"""


@query(_A5, "dag_chain")
def gen_a5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Q18, Q19, Q23, Q24: which of five are above both of a deep pair; by number of right options, what holds of the options."""
    h = dag(spark, d)
    made = multi.a5_pairs(h, EACH, SEED)
    each = made.select("a", "b", "correct", F.posexplode("options").alias("k", "option")).withColumn("right", F.col("correct").contains(F.char(F.col("k") + 65)))
    c = h.ancestors()
    each = each.join(c.select(F.col("name").alias("a"), F.col("ancestor").alias("option"), F.lit(1).alias("u")), ["a", "option"], "left").join(c.select(F.col("name").alias("b"), F.col("ancestor").alias("option"), F.lit(1).alias("v")), ["b", "option"], "left")
    common = F.col("u").isNotNull() & F.col("v").isNotNull()
    one = each.groupBy("a", "b").agg(F.count_if("right").alias("n_right"), F.count_if(F.col("right") & common).alias("rc"), F.count_if(~F.col("right") & common).alias("wc"), F.count_distinct("option").alias("o"), F.count_if(F.col("option").isin(F.col("a"), F.col("b"))).alias("own"))
    return one.groupBy(F.col("n_right").cast("int").alias("n_right")).agg(F.count("*").alias("questions"), F.sum("rc").alias("right_common"), F.sum("wc").alias("wrong_common"), F.sum("o").alias("options"), F.sum("own").alias("own_names"))


# --- paths of different root categories --------------------------------------------------------------------------------

_ROOTS = f"""SELECT n AS n_right, count(*) AS questions, count(*) AS roots_differ, n * count(*) AS right_real, 0::BIGINT AS wrong_real, 0::BIGINT AS reused, 5 * count(*) AS options
    FROM (SELECT {_case(_draw("n4", "q"), generate.A4_WEIGHTS)} AS n FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer) // {PATHS_FOR})) AS q)) GROUP BY n"""


@query(_ROOTS)
def gen_a4_roots(spark: SparkSession, d: str) -> DataFrame:
    """Which of five paths are right, right ones of different root categories; by number of right paths, what holds of them."""
    h = tree(spark, d)
    order = places.preorder(h)
    count = read(spark, d, "customer").count() // PATHS_FOR
    made = multi.paths_of_roots(order, h.middles(), count, SEED)
    real = order.select("name", F.array_join(F.expr("slice(path, 2, size(path) - 1)"), " > ").alias("real"))
    top = order.select("name", F.get("path", F.lit(1)).alias("top"))
    used = made.groupBy("name").agg(F.count("*").alias("uses"))
    each = made.join(real, "name").join(top, "name").join(used, "name").withColumn("is_real", F.col("real") == F.col("option"))
    one = each.groupBy("question").agg(
        F.count_if("right").alias("n"), F.count_distinct(F.when(F.col("right"), F.col("top"))).alias("tops"), F.count_if(F.col("right") & F.col("is_real")).alias("rr"),
        F.count_if(~F.col("right") & F.col("is_real")).alias("wr"), F.count_if(F.col("uses") > 1).alias("re"), F.count_distinct("option").alias("o"),
    )
    return one.groupBy(F.col("n").cast("int").alias("n_right")).agg(
        F.count("*").alias("questions"), F.count_if(F.col("tops") == F.col("n")).alias("roots_differ"), F.sum("rr").alias("right_real"), F.sum("wr").alias("wrong_real"), F.sum("re").alias("reused"), F.sum("o").alias("options")
    )


# --- drawing under caps ------------------------------------------------------------------------------------------------

_CAPPED = f"""WITH_N AS (SELECT count(*) AS n FROM dag_nodes WHERE name <> '{ROOT}')
    SELECT 'all kinds' AS run, 3 * n AS draws, 3 * n AS given, 0::BIGINT AS repeated, 0::BIGINT AS of_other_kind, 3::BIGINT AS most_uses FROM with_n
    UNION ALL SELECT 'more than there is', 4 * n, 3 * n, 0, 0, 3 FROM with_n""".replace("WITH_N", ", with_n")


@query(_CAPPED, "dag_nodes")
def capped_draws(spark: SparkSession, d: str) -> DataFrame:
    """Q01, Q03: every leaf, middle node and any node is asked for once by a task of its kind; then four tasks ask for as many of any kind as there are nodes.

    A node is used at most three times over all tasks, and once in a task, so the first run is served in full, the second up to
    three uses of each node.
    """
    h = dag(spark, d)
    h = Hierarchy(kept(h.nodes), kept(h.edges), h.root)  # each is read several times; edges are distinct pairs of all line items
    kinds = kept(drawing.pools(h))

    def run(name: str, tasks: dict[str, str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(k).alias("kind")) for t, k in tasks.items())))
        draws = h.nodes.where(F.col("name") != h.root).select("name", each.alias("t")).select("name", "t.task", "t.kind").join(kinds, ["kind", "name"], "left_semi")
        draws = draws.select(F.concat_ws("|", "task", "name").alias("id"), "task", "kind")
        draws = kept(draws)
        got = drawing.capped(draws, kinds, generate.NEVER_REUSED, SEED)
        right = kinds.select("kind", "name", F.lit(True).alias("ok"))
        rows = draws.join(got.select("id", "name"), "id", "left").join(right, ["kind", "name"], "left")
        uses = got.groupBy("name").count().agg(F.max("count").alias("most_uses"))
        many = rows.agg(F.count("*").alias("draws"), F.count("name").alias("given"), (F.count("name") - F.count_distinct(F.when(F.col("name").isNotNull(), F.struct("task", "name")))).alias("repeated"), F.count_if(F.col("name").isNotNull() & F.col("ok").isNull()).alias("of_other_kind"))
        return many.join(F.broadcast(uses)).select(F.lit(name).alias("run"), "*")  # one row each

    return run("all kinds", {t: drawing.KINDS[t] for t in ("A1", "A2", "A3", "E1")}).unionByName(run("more than there is", {t: drawing.KINDS[t] for t in ("A2", "E1", "E2", "F")}))


# --- what earlier runs used --------------------------------------------------------------------------------------------

_BANK = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' ELSE 'F' END AS task, o_orderstatus AS st,
      CASE WHEN o_orderstatus = 'P' OR o_custkey % 5 = 0 THEN 'confirmed' ELSE 'flagged' END AS status, 'd' || o_custkey AS target, 'p' || (o_custkey % 500) AS parent,
      ['c' || (o_custkey % 17), 'c' || (o_orderkey % 19), 'c' || ((o_custkey + o_orderkey) % 23)][1:CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 3 END] AS c FROM orders"""


@query(f"""WITH b AS ({_BANK}), u AS (SELECT * FROM b WHERE st <> 'O')
    SELECT id, task FROM b WHERE st = 'O'
      AND NOT (task IN ('E1', 'E2', 'F') AND target IN (SELECT target FROM u WHERE task IN ('E1', 'E2', 'F')))
      AND NOT (task = 'E1' AND list_sort(list_distinct(c)) IN (SELECT list_sort(list_distinct(c)) FROM u WHERE task = 'E1'))
      AND NOT (task = 'E2' AND list_sort(list_distinct(c)) IN (SELECT list_sort(list_distinct(c)) FROM u WHERE task = 'E2'))
      AND NOT (task = 'E3' AND parent IN (SELECT parent FROM u WHERE task = 'E3' AND status = 'confirmed'))""")
def unused_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Q22: open orders as candidate questions, without those whose target, set of candidates, pair or parent an earlier question used."""
    o, c = read(spark, d, "orders"), F.col
    task = F.element_at(F.array(*(F.lit(t) for t in ("E1", "E2", "E3", "F"))), (c("o_orderkey") % 4 + 1).cast("int"))
    three = F.array(F.concat(F.lit("c"), c("o_custkey") % 17), F.concat(F.lit("c"), c("o_orderkey") % 19), F.concat(F.lit("c"), (c("o_custkey") + c("o_orderkey")) % 23))
    bank = o.select(
        c("o_orderkey").alias("id"), task.alias("task"), c("o_orderstatus").alias("st"), F.when((c("o_orderstatus") == "P") | (c("o_custkey") % 5 == 0), "confirmed").otherwise("flagged").alias("status"),
        F.concat(F.lit("d"), c("o_custkey")).alias("target"), F.concat(F.lit("p"), c("o_custkey") % 500).alias("parent"), F.slice(three, F.lit(1), F.when(c("o_orderkey") % 4 == 1, 2).otherwise(3)).alias("candidates"),
    )
    return drawing.without_used(bank.where("st = 'O'"), bank.where("st <> 'O'")).select("id", "task")


# --- questions about any node ------------------------------------------------------------------------------------------

_ANY = (
    f""", kids AS (SELECT source AS p, target AS k, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, target FROM tree)),
    a0 AS (SELECT a.k AS name, a.p AS parent, g.p AS grand, CASE WHEN a.p = '{ROOT}' THEN a.k WHEN g.p = '{ROOT}' THEN a.p ELSE g.p END AS top, a.idx AS s_i, a.n AS s_n, a.p AS s_p, g.idx AS u_i, g.n AS u_n, g.p AS u_p
      FROM kids a LEFT JOIN kids g ON g.k = a.p),
    b0 AS (SELECT a0.*, t.idx AS w_i, t.n AS w_n, t.p AS w_p, CASE WHEN top = name THEN [name] WHEN top = parent THEN [top, name] ELSE [top, parent, name] END AS path FROM a0 JOIN kids t ON t.k = a0.top),
    b1 AS (SELECT *, """
    + ", ".join(f"{_beside('s', j)} AS s{j}, {_beside('u', j)} AS u{j}" for j in range(3))
    + f", {_beside('w', 0)} AS w FROM b0 b), b2 AS (SELECT *, "
    + ", ".join(f"{_child(f'u{j}', f'c{j}')} AS c{j}" for j in range(3))
    + f", {_child('w', 'v')} AS v FROM b1 b), picks AS (SELECT *, {_child('v', 'f')} AS f FROM b2 b)"
)


def _any(task: str, text: str, right: str, wrong: str, where: str = "true") -> str:
    whole = _sql(task, text, right, wrong, where)
    return _ANY + whole[whole.index(", q AS (") :]


def _of_any(spark: SparkSession, d: str) -> DataFrame:
    h = tree(spark, d)
    return generate.picks(h, SEED, h.nodes.where(F.col("name") != h.root))


_TRUE = f"{_draw('a2')} % 2 = 0"
_ABOVE = f"CASE WHEN {_TRUE} THEN CASE WHEN {_draw('up')} % 2 = 0 OR top = name THEN parent ELSE top END ELSE v END"
_RANKS = "[" + ", ".join(" || ' > ' || ".join(o) for o in (("s0", "f", "c0"), ("c0", "s0", "f"), ("c0", "f", "s0"), ("f", "s0", "c0"), ("f", "c0", "s0"))) + "]"


@query(_any("A2", f"'Is ''' || {_ABOVE} || ''' above ''' || name || '''?'", f"[CASE WHEN {_TRUE} THEN 'Yes' ELSE 'No' END]", f"[CASE WHEN {_TRUE} THEN 'No' ELSE 'Yes' END]", f"({_ABOVE}) IS NOT NULL"), "tree")
def gen_a2_any(spark: SparkSession, d: str) -> DataFrame:
    """Q08, Q01: ancestors of every node, leaves, middle nodes and root categories."""
    return _out(generate.a2(_of_any(spark, d), SEED))


@query(_any("A5", "'What joins ''' || name || ''' and ''' || c0 || '''?'", "[grand]", "[parent, u0, v]", "c0 IS NOT NULL"), "tree")
def gen_a5_any(spark: SparkSession, d: str) -> DataFrame:
    """Q11, Q01: what joins any node and a cousin."""
    return _out(generate.a5(_of_any(spark, d), SEED))


@query(_any("E1", "'Rank by likeness to ''' || name || '''.'", "[s0 || ' > ' || c0 || ' > ' || f]", f"list_slice({_hashed('rank', _RANKS)}, 1, 3)", "s0 IS NOT NULL AND c0 IS NOT NULL AND f IS NOT NULL"), "tree")
def gen_e1_any(spark: SparkSession, d: str) -> DataFrame:
    """Q12, Q01: a sibling, a cousin and a stranger of any node by distance."""
    return _out(generate.e1(_of_any(spark, d), SEED))


@query(_any("E2", "'Which is nearest to ''' || name || '''?'", "[s0]", "[c0, f]"), "tree")
def gen_e2_any(spark: SparkSession, d: str) -> DataFrame:
    """Q13, Q01."""
    return _out(generate.e2(_of_any(spark, d), SEED))


@query(_ANY + " SELECT name, '''' || name || ''' is a descriptor. Hierarchically, it is classified as: ' || array_to_string(path, ' → ') AS reference FROM picks", "tree")
def gen_f_any(spark: SparkSession, d: str) -> DataFrame:
    """Q15, TX24, Q01: where every node stands."""
    return generate.f_single(_of_any(spark, d)).select("name", "reference")


# --- the odd one out ---------------------------------------------------------------------------------------------------

_WARES = f"""WITH tree AS (SELECT DISTINCT '{ROOT}' AS source, p_type AS target FROM part UNION ALL SELECT DISTINCT p_type, p_type || ' ' || p_brand FROM part
    UNION ALL SELECT p_type || ' ' || p_brand, p_name || ' ' || p_partkey FROM part)"""
_PLAIN = {x: f"replace(replace(lower({x}), ' ', ''), '-', '')" for x in ("name", "s0", "s1", "f")}
_WORDS = {x: f"list_distinct(string_split_regex(trim(lower({x})), '\\s+'))" for x in _PLAIN}
_ALIKE = " OR ".join(f"starts_with({a}, {b})" for x, a in _PLAIN.items() for y, b in _PLAIN.items() if x != y)
_SAME = ("name", "s0", "s1")
_IN_ALL = f"len(list_filter(list_distinct(flatten([{', '.join(_WORDS[x] for x in _SAME)}])), lambda w: len(w) >= 3 AND contains(lower(name), w) AND contains(lower(s0), w) AND contains(lower(s1), w))) > 0"
_WITH_F = " OR ".join(f"len(list_intersect({_WORDS[x]}, {_WORDS['f']})) > 0" for x in _SAME)


@query(_WARES + _sql("E3", "'Which does not belong?'", "[f]", "[name, s0, s1]", f"s0 IS NOT NULL AND s1 IS NOT NULL AND f IS NOT NULL AND NOT ({_ALIKE}) AND NOT ({_IN_ALL}) AND NOT ({_WITH_F})"))
def gen_e3_parts(spark: SparkSession, d: str) -> DataFrame:
    """The odd one out among parts by type and brand, whose names often give it away."""
    p, c = read(spark, d, "part"), F.col
    brand, leaf = F.concat_ws(" ", "p_type", "p_brand"), F.concat_ws(" ", "p_name", c("p_partkey").cast("string"))
    edge = lambda s, t: p.select(s.alias("source"), t.alias("target")).distinct()
    edges = edge(F.lit(ROOT), c("p_type")).unionByName(edge(c("p_type"), brand)).unionByName(edge(brand, leaf)).withColumns({"path_type": F.lit("sub-category"), "eid": F.xxhash64("target")})
    nodes = edges.select(F.col("target").alias("name"), F.col("eid").alias("ord")).unionByName(spark.createDataFrame([(ROOT, 0)], "name string, ord long"))
    h = Hierarchy(nodes, edges, ROOT)
    return _out(generate.e3(generate.picks(h, SEED), SEED))
