"""Queries that generate questions from the tree of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate
from ..operators.hierarchy import Hierarchy
from .graph import pairs, tree
from .registry import query

SEED = "s7"


def _draw(what: str, name: str = "name") -> str:
    return f"('0x' || left(md5(concat_ws('|', '{SEED}', '{what}', {name})), 8))::BIGINT"


def _beside(tag: str, j: int) -> str:
    return f"""(SELECT k FROM kids x WHERE x.p = b.{tag}_p AND b.{tag}_n > {j + 1} AND x.idx = (b.{tag}_i + 1 + ({_draw(tag, 'b.name')} + {j}) % greatest(b.{tag}_n - 1, 1)) % b.{tag}_n)"""


def _child(node: str, what: str) -> str:
    return f"(SELECT x.k FROM kids x WHERE x.p = b.{node} AND x.idx = {_draw(what, 'b.name')} % x.n)"


_PICKS = (
    """, kids AS (SELECT source AS p, target AS k, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, target FROM tree)),
    b0 AS (SELECT a.k AS name, a.p AS parent, g.p AS top, a.idx AS s_i, a.n AS s_n, a.p AS s_p, g.idx AS u_i, g.n AS u_n, g.p AS u_p, t.idx AS w_i, t.n AS w_n, t.p AS w_p
      FROM kids a JOIN kids g ON g.k = a.p JOIN kids t ON t.k = g.p WHERE a.k NOT IN (SELECT p FROM kids)),
    b1 AS (SELECT *, """
    + ", ".join(f"{_beside('s', j)} AS s{j}, {_beside('u', j)} AS u{j}" for j in range(3))
    + f", {_beside('w', 0)} AS w FROM b0 b), b2 AS (SELECT *, "
    + ", ".join(f"{_child(f'u{j}', f'c{j}')} AS c{j}" for j in range(3))
    + f", {_child('w', 'v')} AS v FROM b1 b), picks AS (SELECT *, {_child('v', 'f')} AS f FROM b2 b)"
)


def _hashed(what: str, xs: str) -> str:
    """A list in an order by hash."""
    return f"list_transform(list_sort(list_transform({xs}, lambda o: md5(concat_ws('|', '{SEED}', '{what}', name, o)) || o)), lambda z: substr(z, 33))"


def _sql(task: str, text: str, right: str, wrong: str, where: str = "true", source: str = "picks") -> str:
    return (
        _PICKS
        + f""", q AS (SELECT name, {text} AS text, {right} AS r, list_concat({right}, {wrong}) AS o FROM {source} WHERE {where}),
    z AS (SELECT *, {_hashed(task, 'o')} AS options FROM q WHERE len(list_filter(o, lambda x: x IS NULL)) = 0 AND len(list_distinct(o)) = len(o))
    SELECT '{task}_' || left(md5(concat_ws('|', '{SEED}', '{task}', name)), 8) AS id, '{task}' AS task_type, name, text, array_to_string(options, '|') AS options,
    array_to_string(list_filter(list_transform(options, lambda x, i: CASE WHEN list_contains(r, x) THEN chr(CAST(64 + i AS INTEGER)) END), lambda x: x IS NOT NULL), ',') AS correct FROM z"""
    )


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("options", F.array_join("options", "|"))


def _picked(spark: SparkSession, d: str) -> tuple[Hierarchy, DataFrame]:
    h = tree(spark, d)
    return h, generate.picks(h, SEED)


@query(_PICKS + " SELECT name, parent, top, s0, s1, s2, u0, u1, u2, c0, c1, c2, w, v, f FROM picks", "tree")
def gen_picks(spark: SparkSession, d: str) -> DataFrame:
    """Relatives and strangers of every leaf."""
    return _picked(spark, d)[1].drop("grand", "path")


@query(_sql("A1", "'Which categories hold ''' || name || '''?'", "[top]", f"list_slice({_hashed('root', '(SELECT list(DISTINCT t.target) FROM tree t WHERE t.source = chr(82) || chr(79) || chr(79) || chr(84) AND t.target <> top)')}, 1, 5)"), "tree")
def gen_a1(spark: SparkSession, d: str) -> DataFrame:
    """Q07, F18."""
    h, p = _picked(spark, d)
    return _out(generate.a1(p, h, SEED))


_TRUE = f"{_draw('a2')} % 2 = 0"
_ABOVE = f"CASE WHEN {_TRUE} THEN CASE WHEN {_draw('up')} % 2 = 0 THEN parent ELSE top END ELSE v END"


@query(_sql("A2", f"'Is ''' || {_ABOVE} || ''' above ''' || name || '''?'", f"[CASE WHEN {_TRUE} THEN 'Yes' ELSE 'No' END]", f"[CASE WHEN {_TRUE} THEN 'No' ELSE 'Yes' END]", f"({_ABOVE}) IS NOT NULL"), "tree")
def gen_a2(spark: SparkSession, d: str) -> DataFrame:
    """Q08, Q03."""
    return _out(generate.a2(_picked(spark, d)[1], SEED))


@query(_sql("A3", "'Which is a sibling of ''' || name || '''?'", "[s0]", "[c0, c1, c2]"), "tree")
def gen_a3(spark: SparkSession, d: str) -> DataFrame:
    """Q09, Q04."""
    return _out(generate.a3(_picked(spark, d)[1], SEED))


@query(_sql("A4", "'Which path leads to ''' || name || '''?'", "[top || ' → ' || parent || ' → ' || name]", "[w || ' → ' || parent || ' → ' || name, top || ' → ' || v || ' → ' || name, parent || ' → ' || top || ' → ' || name]"), "tree")
def gen_a4(spark: SparkSession, d: str) -> DataFrame:
    """Q10, Q05, TX23."""
    return _out(generate.a4(_picked(spark, d)[1], SEED))


@query(_sql("A5", "'What joins ''' || name || ''' and ''' || c0 || '''?'", "[top]", "[parent, u0, v]", "c0 IS NOT NULL"), "tree")
def gen_a5(spark: SparkSession, d: str) -> DataFrame:
    """Q11, Q06."""
    return _out(generate.a5(_picked(spark, d)[1], SEED))


_RANKS = "[" + ", ".join(" || ' > ' || ".join(o) for o in (("s0", "f", "c0"), ("c0", "s0", "f"), ("c0", "f", "s0"), ("f", "s0", "c0"), ("f", "c0", "s0"))) + "]"


@query(_sql("E1", "'Rank by likeness to ''' || name || '''.'", "[s0 || ' > ' || c0 || ' > ' || f]", f"list_slice({_hashed('rank', _RANKS)}, 1, 3)", "s0 IS NOT NULL AND c0 IS NOT NULL AND f IS NOT NULL"), "tree")
def gen_e1(spark: SparkSession, d: str) -> DataFrame:
    """Q12, M08, W05."""
    return _out(generate.e1(_picked(spark, d)[1], SEED))


@query(_sql("E2", "'Which is nearest to ''' || name || '''?'", "[s0]", "[c0, f]"), "tree")
def gen_e2(spark: SparkSession, d: str) -> DataFrame:
    """Q13."""
    return _out(generate.e2(_picked(spark, d)[1], SEED))


@query(_PICKS + """ SELECT name, '''' || name || ''' is a descriptor. Hierarchically, it is classified as: ' || top || ' → ' || parent || ' → ' || name AS reference FROM picks""", "tree")
def gen_f(spark: SparkSession, d: str) -> DataFrame:
    """Q15, TX24."""
    return generate.f_single(_picked(spark, d)[1]).select("name", "reference")


_F_PAIRS = """, l AS (SELECT p.a, p.b, arg_min(x.ancestor, x.dist) AS lca, min(x.dist + y.dist) AS hops FROM pairs p JOIN tree_self x ON x.name = p.a JOIN tree_self y ON y.name = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b)
    SELECT a, b, concat_ws(' ', 'Comparing ''' || a || ''' and ''' || b || ''':', 'They share a common ancestor: ''' || lca || '''', CASE WHEN hops > 0 THEN 'The graph distance between them is ' || hops || ' levels' END,
    CASE WHEN hops > 0 THEN CASE WHEN hops <= 2 THEN 'suggesting they are relatively similar' WHEN hops <= 4 THEN 'suggesting they are moderately related' ELSE 'suggesting they are quite distinct' END END) AS reference FROM l"""


@query(_F_PAIRS, "pairs", "tree_self")
def gen_f_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Q15, TX24: pairs."""
    return generate.f_pair(tree(spark, d).lca(pairs(spark, d)))


@query(", k AS (SELECT source, list_sort(list(DISTINCT target)) AS k FROM tree WHERE source IN (SELECT target FROM tree WHERE source = 'ROOT') GROUP BY source) SELECT source AS name, '''' || source || ''' is a root category. It encompasses: ' || array_to_string(k[1:5], ', ') || CASE WHEN len(k) > 5 THEN ' and ' || (len(k) - 5) || ' others' ELSE '' END AS reference FROM k", "tree")
def gen_f_categories(spark: SparkSession, d: str) -> DataFrame:
    """Q15, TX24: categories."""
    return generate.f_category(tree(spark, d))


def _case(number: str, weights: list[int]) -> str:
    total, out = 0, []
    for i, w in enumerate(weights[:-1]):
        total += w
        out.append(f"WHEN {number} % {sum(weights)} < {total} THEN {i}")
    return f"CASE {' '.join(out)} ELSE {len(weights) - 1} END"


def _a4m() -> str:
    n = _case(_draw("n4"), generate.A4_WEIGHTS)
    leaves = [("name", "parent", "top"), ("s0", "parent", "top"), ("c0", "u0", "top"), ("c1", "u1", "top"), ("f", "v", "w")]
    good, bad = [], []
    for k, (leaf, mid, top) in enumerate(leaves):
        ot, om = ("top", "parent") if top == "w" else ("w", "v")
        good.append(f"CASE WHEN {k} < {n} THEN {top} || ' > ' || {mid} || ' > ' || {leaf} END")
        bad.append(f"CASE WHEN {k} >= {n} THEN CASE WHEN {_draw(f'r{k}')} % 10 < 3 THEN {ot} || ' > ' || {mid} || ' > ' || {leaf} ELSE {top} || ' > ' || {om} || ' > ' || {leaf} END END")
    some = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    return _sql("A4M", "'Which paths are right?'", some(good), some(bad), "w IS NOT NULL AND v IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL AND s0 IS NOT NULL AND f IS NOT NULL")


@query(_a4m(), "tree")
def gen_a4_multi(spark: SparkSession, d: str) -> DataFrame:
    """Q16, Q17, M10, G23."""
    h, p = _picked(spark, d)
    return _out(generate.a4_multi(p, h, SEED))


_N5 = f"least({_case(_draw('n5'), generate.A5_WEIGHTS)}, 3)"


@query(
    _sql("A5M", "'Which are above both ''' || name || ''' and ''' || s0 || '''?'", f"list_slice({_hashed('v', '[parent, top, chr(82) || chr(79) || chr(79) || chr(84)]')}, 1, {_N5})", f"list_slice([u0, u1, u2, w, v], 1, 5 - {_N5})", "s0 IS NOT NULL AND u0 IS NOT NULL AND u1 IS NOT NULL AND u2 IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL"),
    "tree",
)
def gen_a5_multi(spark: SparkSession, d: str) -> DataFrame:
    """Q18, Q19, Q23, Q24."""
    h, p = _picked(spark, d)
    return _out(generate.a5_multi(p, h.root, SEED))


@query(
    """WITH p AS (SELECT p_partkey AS id, [p_name, (SELECT x.p_name FROM part x WHERE x.p_partkey = p.p_partkey + 1), (SELECT x.p_name FROM part x WHERE x.p_partkey = p.p_partkey + 2)] AS n FROM part p WHERE p_partkey + 2 < (SELECT count(*) FROM part)),
    s AS (SELECT id, n, list_transform(n, lambda x: replace(replace(lower(x), ' ', ''), '-', '')) AS q FROM p)
    SELECT id, starts_with(q[1], q[2]) OR starts_with(q[2], q[1]) OR starts_with(q[1], q[3]) OR starts_with(q[3], q[1]) OR starts_with(q[2], q[3]) OR starts_with(q[3], q[2]) AS near,
    len(list_filter(list_distinct(flatten(list_transform(n, lambda x: string_split(lower(x), ' ')))), lambda w: len(w) >= 3 AND contains(lower(n[1]), w) AND contains(lower(n[2]), w) AND contains(lower(n[3]), w))) > 0 AS common FROM s"""
)
def name_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Names that give a group away."""
    from ..sources.tables import read

    p = read(spark, d, "part").select("p_partkey", "p_name")
    two = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n1"))
    three = p.select((F.col("p_partkey") - 2).alias("p_partkey"), F.col("p_name").alias("n2"))
    df = p.join(two, "p_partkey").join(three, "p_partkey").withColumn("n", F.array("p_name", "n1", "n2"))
    return df.select(F.col("p_partkey").alias("id"), generate.near_duplicates(F.col("n")).alias("near"), generate.common_word(F.col("n")).alias("common"))


@query(None)
def gen_e3(spark: SparkSession, d: str) -> DataFrame:
    """Q14: held against its predicates by the tests; customers' names begin alike, so the tree gives few or no rows."""
    return _out(generate.e3(_picked(spark, d)[1], SEED))
