"""Queries over hierarchies: a tree of customers and a graph of parts with many parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodefilter, ordering, replay, validate
from ..operators.hierarchy import Hierarchy
from ..sources import tables
from ..steps import kept
from .registry import query


def tree(spark: SparkSession, d: str) -> Hierarchy:
    return Hierarchy(*tables.tree(spark, d), tables.ROOT)


def dag(spark: SparkSession, d: str) -> Hierarchy:
    return Hierarchy(*tables.dag(spark, d), tables.ROOT)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (a, b) of customers, one for each."""
    c = tables.read(spark, d, "customer")
    n = c.agg(F.count("*").alias("n"))
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return c.crossJoin(F.broadcast(n)).select(name(F.col("c_custkey")).alias("a"), name(F.col("c_custkey") * 7 % F.col("n")).alias("b"))  # n is one row


@query("SELECT d.target AS name, string_agg(d.source, ',' ORDER BY n.ord, d.source) AS parents FROM dag d JOIN dag_nodes n ON n.name = d.source GROUP BY d.target", "dag_nodes")
def parents_all(spark: SparkSession, d: str) -> DataFrame:
    """G06."""
    return dag(spark, d).parents().withColumn("parents", F.array_join("parents", ","))


@query("SELECT d.source AS name, string_agg(d.target, ',' ORDER BY n.ord, d.target) AS children FROM tree d JOIN tree_nodes n ON n.name = d.target GROUP BY d.source", "tree_nodes")
def children(spark: SparkSession, d: str) -> DataFrame:
    """G06."""
    return tree(spark, d).children().withColumn("children", F.array_join("children", ","))


@query("SELECT name, parent FROM dag_first", "dag_first")
def first_parent(spark: SparkSession, d: str) -> DataFrame:
    """Of several parents the first in node order."""
    return dag(spark, d).first_parent()


@query("SELECT name, ancestor, dist FROM dag_chain", "dag_chain")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """The chain of first parents."""
    return dag(spark, d).ancestors()


@query(", r(name, descendant) AS (SELECT source, target FROM dag UNION SELECT r.name, d.target FROM r JOIN dag d ON d.source = r.descendant) SELECT name, count(*) AS n FROM r GROUP BY name", "dag")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    """All that is reached, over every parent."""
    return dag(spark, d).descendants().groupBy("name").agg(F.count("*").alias("n"))


@query(
    """, r(name) AS (SELECT 'NATION_3' UNION SELECT d.target FROM r JOIN dag d ON d.source = r.name) SELECT source, target FROM dag WHERE source IN (SELECT name FROM r) AND target IN (SELECT name FROM r)""",
    "dag",
)
def descendants_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges among a node and its descendants."""
    return dag(spark, d).subgraph("NATION_3").edges.select("source", "target")


@query("SELECT name FROM dag_nodes WHERE name NOT IN (SELECT source FROM dag)", "dag_nodes")
def leaves(spark: SparkSession, d: str) -> DataFrame:
    """G11, T9."""
    return dag(spark, d).leaves()


@query("SELECT name FROM dag_nodes WHERE name IN (SELECT source FROM dag) AND name IN (SELECT target FROM dag) AND name <> 'ROOT'", "dag_nodes")
def middles(spark: SparkSession, d: str) -> DataFrame:
    """G11, T9."""
    return dag(spark, d).middles()


@query("SELECT n.name, arg_max(c.ancestor, c.dist) FILTER (WHERE c.ancestor IN (SELECT target FROM dag WHERE source = 'ROOT')) AS category FROM dag_nodes n LEFT JOIN dag_chain c ON c.name = n.name GROUP BY n.name", "dag_nodes", "dag_chain")
def root_category(spark: SparkSession, d: str) -> DataFrame:
    """None for root categories themselves."""
    return dag(spark, d).root_category()


@query(
    """, rc AS (SELECT n.name, arg_max(c.ancestor, c.dist) FILTER (WHERE c.ancestor IN (SELECT target FROM dag WHERE source = 'ROOT')) AS category FROM dag_nodes n LEFT JOIN dag_chain c ON c.name = n.name GROUP BY n.name)
    SELECT d.target AS name, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM dag d JOIN rc ON rc.name = d.source AND category IS NOT NULL GROUP BY d.target""",
    "dag_nodes",
    "dag_chain",
)
def root_categories_dag(spark: SparkSession, d: str) -> DataFrame:
    """G19, G10, T6."""
    return dag(spark, d).root_categories_of_parents().withColumn("categories", F.array_join("categories", ","))


_LCA = """, l AS (SELECT p.a, p.b, arg_min(x.ancestor, x.dist) AS lca, min(x.dist + y.dist) AS hops FROM pairs p JOIN tree_self x ON x.name = p.a JOIN tree_self y ON y.name = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b)"""


@query(_LCA + " SELECT a, b, lca, hops FROM l", "pairs", "tree_self")
def lca(spark: SparkSession, d: str) -> DataFrame:
    """Nearest common node and hops between pairs."""
    return tree(spark, d).lca(pairs(spark, d))


_COMMON = "SELECT p.a, p.b, x.ancestor FROM pairs p JOIN tree_chain x ON x.name = p.a JOIN tree_chain y ON y.name = p.b AND y.ancestor = x.ancestor WHERE x.ancestor <> 'ROOT'"


@query(_COMMON, "pairs", "tree_chain")
def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """G22, U03, J12."""
    return tree(spark, d).common_ancestors(pairs(spark, d))


_ONE_SIDED = """, x AS (SELECT p.a, p.b, list_sort(list_concat(list_filter(ca, lambda v: NOT list_contains(cb, v)), list_filter(cb, lambda v: NOT list_contains(ca, v)))) AS one_side FROM pairs p
    JOIN (SELECT name, list(ancestor) AS ca FROM tree_chain GROUP BY name) s ON s.name = p.a JOIN (SELECT name, list(ancestor) AS cb FROM tree_chain GROUP BY name) t ON t.name = p.b) SELECT a, b, array_to_string(one_side, ',') AS one_side FROM x"""


@query(_ONE_SIDED, "pairs", "tree_chain")
def one_sided_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of only one of two nodes."""
    return _one_sided(tree(spark, d), pairs(spark, d))


def _one_sided(h: Hierarchy, of: DataFrame) -> DataFrame:
    c = h.ancestors().groupBy("name").agg(F.collect_list("ancestor").alias("c"))  # a chain
    p = of.join(c.select(F.col("name").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("name").alias("b"), F.col("c").alias("cb")), "b")
    return p.select("a", "b", F.array_join(F.array_sort(F.array_union(F.array_except("ca", "cb"), F.array_except("cb", "ca"))), ",").alias("one_side"))


_BOTH = ", e AS (SELECT source AS x, target AS y, CASE path_type WHEN 'related' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM tree UNION ALL SELECT target, source, CASE path_type WHEN 'related' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END FROM tree)"


def _walks(weight: str) -> str:
    return _BOTH + f""", r(source, name, path, distance) AS (SELECT r_name, r_name, [r_name], 0.0::DOUBLE FROM region UNION ALL SELECT r.source, e.y, list_append(r.path, e.y), r.distance + {weight} FROM r JOIN e ON e.x = r.name WHERE NOT list_contains(r.path, e.y) AND len(r.path) <= 4)
    SELECT source, name, min(distance) AS distance FROM r GROUP BY source, name"""


@query(_walks("1.0"), "tree")
def hop_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least hops, in both directions, from every region."""
    return tree(spark, d).distances(tables.read(spark, d, "region").select(F.col("r_name").alias("name")))


@query(_walks("e.w"), "tree")
def weighted_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least sum of weights."""
    return tree(spark, d).distances(tables.read(spark, d, "region").select(F.col("r_name").alias("name")), weighted=True)


@query(None)
def k_paths(spark: SparkSession, d: str) -> DataFrame:
    """The four shortest simple paths from the root to every part; a test holds them against brute force."""
    p = tables.read(spark, d, "part").select(F.lit(tables.ROOT).alias("a"), F.concat(F.lit("part"), "p_partkey").alias("b"))
    return dag(spark, d).paths(p, 4, reverse=False).withColumn("path", F.array_join("path", ">"))


@query("SELECT source AS i, target AS j, count(*) AS value FROM tree WHERE source <> 'ROOT' GROUP BY ALL", "tree")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Sparse, without the root."""
    return tree(spark, d).adjacency(with_root=False)


@query(", b AS (SELECT source AS i, target AS j FROM tree UNION ALL SELECT target, source FROM tree) SELECT i, j, 2 * count(*) AS value FROM b GROUP BY ALL", "tree")
def adjacency_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Both directions count twice."""
    return tree(spark, d).adjacency(reverse=True)


@query(", f AS (SELECT target AS name, source AS parent FROM tree) SELECT a.name, count(*) AS n, min(b.name) AS first FROM f a JOIN f b ON a.parent = b.parent AND a.name <> b.name GROUP BY a.name", "tree")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    """J07."""
    return tree(spark, d).sibling_summary()


@query(", f AS (SELECT target AS name, source AS parent FROM tree), s AS (SELECT a.name, b.name AS sibling FROM f a JOIN f b ON a.parent = b.parent AND a.name <> b.name) SELECT f.name, count(DISTINCT k.name) AS n FROM f JOIN s ON s.name = f.parent JOIN f k ON k.parent = s.sibling GROUP BY f.name", "tree")
def cousins(spark: SparkSession, d: str) -> DataFrame:
    """J08."""
    return tree(spark, d).cousin_summary()


@query(_walks("1.0").replace("SELECT source, name, min(distance) AS distance FROM r GROUP BY source, name", "SELECT source, count(*) AS n FROM (SELECT source, name, min(distance) AS m FROM r GROUP BY source, name) WHERE m BETWEEN 2 AND 3 GROUP BY source"), "tree")
def distance_range(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within a range of distances."""
    return hop_distance(spark, d).where(F.col("distance").between(2, 3)).groupBy("source").agg(F.count("*").alias("n"))


_CYCLIC = """, back AS (SELECT source, target FROM dag UNION ALL SELECT 'part' || p_partkey, 'NATION_' || (p_partkey % 25) FROM part WHERE p_partkey % 10 = 3),
    reach(name, seen) AS (SELECT source, target FROM {t} WHERE source LIKE 'NATION%' UNION SELECT r.name, b.target FROM reach r JOIN {t} b ON b.source = r.seen),
    loops AS (SELECT DISTINCT name FROM reach WHERE name = seen)"""


@query(_CYCLIC.format(t="dag") + " SELECT count(*) AS nodes_left FROM loops", "dag")
def dag_check(spark: SparkSession, d: str) -> DataFrame:
    """The derived graph has no cycle (every cycle would go through a nation)."""
    return dag(spark, d).is_dag()


@query(_CYCLIC.format(t="back") + " SELECT CASE WHEN (SELECT count(*) FROM loops) > 0 THEN 1 ELSE 0 END AS cyclic, (SELECT count(DISTINCT name) FROM (SELECT name FROM loops UNION ALL SELECT r.seen FROM reach r JOIN loops l ON l.name = r.name)) AS nodes_left", "dag")
def dag_check_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The same graph with edges back from parts to nations: what lies on its cycles or behind them is left."""
    h = dag(spark, d)
    back = tables.read(spark, d, "part").where("p_partkey % 10 = 3").select(
        F.concat(F.lit("part"), "p_partkey").alias("source"), F.concat(F.lit("NATION_"), F.col("p_partkey") % 25).alias("target"), F.lit("sub-category").alias("path_type"), F.col("p_partkey").alias("eid")
    )
    edges = h.edges.select("source", "target", "path_type", "eid").unionByName(back)
    ends = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct()
    return Hierarchy(ends.withColumn("ord", F.lit(0).cast("long")), edges, tables.ROOT).is_dag().select((F.col("nodes_left") > 0).cast("int").alias("cyclic"), "nodes_left")


_DOWN = """, e AS (SELECT source AS x, target AS y, CASE path_type WHEN 'related' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM tree),
    r(source, name, distance) AS (SELECT r_name, r_name, 0.0::DOUBLE FROM region UNION ALL SELECT r.source, e.y, r.distance + e.w FROM r JOIN e ON e.x = r.name)
    SELECT x.r_name AS source, n.name, coalesce(min(r.distance), 'infinity'::DOUBLE) AS distance FROM region x CROSS JOIN tree_nodes n LEFT JOIN r ON r.source = x.r_name AND r.name = n.name GROUP BY ALL"""


@query(_DOWN, "tree_nodes")
def directed_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least sum of weights along the edges, from every region to every node; infinity where no path leads."""
    h = tree(spark, d)
    r = tables.read(spark, d, "region").select(F.col("r_name").alias("a")).distinct()  # a fixed table of 5 rows
    pairs = h.nodes.select(F.col("name").alias("b")).distinct().crossJoin(F.broadcast(r))  # customers may share a name, regions too
    return h.distance_of(pairs, weighted=True, reverse=False).select(F.col("a").alias("source"), F.col("b").alias("name"), "distance")


@query(
    """, c AS (SELECT 'NATION_' || n_nationkey AS a, r_name AS b, n_nationkey AS k FROM nation, region)
    SELECT c.a, c.b, coalesce(f.path_type, r.path_type) AS path_type, CASE WHEN f.path_type IS NOT NULL THEN 'forward' WHEN r.path_type IS NOT NULL THEN 'reverse' ELSE 'X' END AS direction FROM c LEFT JOIN tree f ON f.source = c.a AND f.target = c.b LEFT JOIN tree r ON r.source = c.b AND r.target = c.a""",
    "tree",
)
def connections(spark: SparkSession, d: str) -> DataFrame:
    """G05."""
    r, n = tables.read(spark, d, "region"), tables.read(spark, d, "nation")
    p = n.select(F.col("n_name").alias("a")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("b"))))  # fixed tables of 25 and 5 rows
    return tree(spark, d).connection(p)


@query("SELECT source, target FROM tree WHERE target <> 'NATION_4' AND source <> 'NATION_4' AND NOT (source = 'ROOT' AND target = 'ASIA') UNION ALL SELECT 'ASIA', 'new'", "tree")
def changed_graph(spark: SparkSession, d: str) -> DataFrame:
    """A node and its edges gone, an edge gone, a node and an edge added."""
    h = tree(spark, d).without_node("NATION_4").without_edge("ASIA", "ROOT").with_node("new", 99_999_999).with_edge("ASIA", "new", "synonym", 99_999_999)
    return h.edges.select("source", "target")


_FACTS = """, f AS (SELECT n.name, n.name NOT IN (SELECT source FROM tree) AS is_leaf, coalesce((SELECT max(dist) FROM tree_chain c WHERE c.name = n.name), 0) AS depth, t.source AS parent,
    CASE WHEN t.source IS NULL THEN 0 ELSE (SELECT count(*) - 1 FROM tree s WHERE s.source = t.source) END AS n_siblings FROM tree_nodes n LEFT JOIN tree t ON t.target = n.name)"""
_CONFIG = nodefilter.FilterConfig(min_depth=2, excluded_parents=("NATION_1", "NATION_7"), excluded_keywords=("#00000001", "root"), min_siblings=10, blacklist=("Customer#000000033",), whitelist=("NATION_2", "Customer#000000010", "nobody"))
_FILTERED = _FACTS + """, g AS (SELECT *, is_leaf AND depth >= 2 AS structural, coalesce(parent IN ('NATION_1', 'NATION_7'), false) AS bad_parent, contains(lower(name), '#00000001') OR contains(lower(name), 'root') AS keyword FROM f),
    h AS (SELECT *, structural AND NOT bad_parent AND NOT keyword AS categorical FROM g), k AS (SELECT *, categorical AND n_siblings >= 10 AS quality FROM h),
    r AS (SELECT *, (quality AND name <> 'Customer#000000033') OR name IN ('NATION_2', 'Customer#000000010', 'nobody') AS kept FROM k)"""


@query(_FACTS + " SELECT * FROM f", "tree_nodes", "tree_chain")
def node_facts(spark: SparkSession, d: str) -> DataFrame:
    """G25, G21."""
    return tree(spark, d).facts().select("name", "is_leaf", F.col("depth").cast("int").alias("depth"), "parent", F.col("n_siblings").cast("long").alias("n_siblings"))


@query(_FILTERED + " SELECT name, structural, categorical, quality, kept FROM r", "tree_nodes", "tree_chain")
def node_filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whitelist wins."""
    return nodefilter.staged(tree(spark, d).facts(), _CONFIG).select("name", "structural", "categorical", "quality", "kept")


@query(
    _FILTERED + """ SELECT count(*) AS total, count(*) FILTER (WHERE structural) AS after_structural, count(*) FILTER (WHERE categorical) AS after_category, count(*) FILTER (WHERE quality) AS after_quality, count(*) FILTER (WHERE kept) AS final,
    printf('%.1f%%', count(*) FILTER (WHERE kept) * 100.0 / count(*)) AS rate FROM r""",
    "tree_nodes",
    "tree_chain",
)
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    return nodefilter.funnel(tree(spark, d).facts(), _CONFIG)


@query(_FILTERED + " SELECT parent, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS names FROM r WHERE kept GROUP BY parent", "tree_nodes", "tree_chain")
def filtered_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A23, G24."""
    return nodefilter.by_parent(tree(spark, d).facts(), _CONFIG).select("parent", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",")).alias("names"))


_CHECKED = (
    """, c AS (SELECT e.event_id, x.name, i.i FROM events e, (SELECT unnest(range(12)) AS i) i, LATERAL (SELECT CASE WHEN i.i % 3 = 0 THEN 'nobody' || i.i ELSE 'NATION_' || ((e.event_id + i.i) % 25) END AS name) x WHERE i.i < 10)
    SELECT event_id AS call_id, true AS truncated, string_agg(name, ',' ORDER BY i) FILTER (WHERE name LIKE 'NATION%') AS valid, string_agg(name, ',' ORDER BY i) FILTER (WHERE name NOT LIKE 'NATION%') AS invalid FROM c GROUP BY event_id"""
    .replace(", c AS", "WITH c AS", 1)
)


@query(_CHECKED)
def checked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a checking call, the first ten, split by whether they are nodes."""
    return _checked_names(spark, d, tables.read(spark, d, "events"))


def _checked_names(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    names = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i % 3 == 0, F.concat(F.lit("nobody"), i.cast("string"))).otherwise(F.concat(F.lit("NATION_"), ((F.col("event_id") + i) % 25).cast("string"))))
    calls = events.select(F.col("event_id").alias("call_id"), names.alias("names"))
    got = replay.checked_names(calls, tree(spark, d).nodes)
    return got.select("call_id", "truncated", F.array_join("valid", ",").alias("valid"), F.array_join("invalid", ",").alias("invalid"))


_ANSWERS = """, c AS (SELECT event_id AS call_id, CASE event_id % 3 WHEN 0 THEN 'get_parent' WHEN 1 THEN 'get_children' ELSE 'fly' END AS tool, CASE WHEN event_id % 7 = 0 THEN 'nobody' ELSE 'NATION_' || (event_id % 25) END AS name FROM events)
    SELECT call_id, tool, name, CASE WHEN name = 'nobody' THEN NULL WHEN tool = 'get_parent' THEN (SELECT string_agg(source, ',' ORDER BY source) FROM tree WHERE target = c.name) WHEN tool = 'get_children' THEN coalesce((SELECT string_agg(target, ',' ORDER BY eid) FROM tree WHERE source = c.name), '') ELSE '' END AS result,
    CASE WHEN tool = 'fly' THEN 'unknown tool: fly' WHEN name = 'nobody' THEN '''nobody'' not found' END AS error FROM c"""


@query(_ANSWERS, "tree")
def tool_answers(spark: SparkSession, d: str) -> DataFrame:
    """G26, G27, UD5."""
    return _tool_answers(spark, d, tables.read(spark, d, "events"))


def _tool_answers(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    tool = F.when(e % 3 == 0, "get_parent").when(e % 3 == 1, "get_children").otherwise("fly")
    calls = events.select(e.alias("call_id"), tool.alias("tool"), F.when(e % 7 == 0, "nobody").otherwise(F.concat(F.lit("NATION_"), e % 25)).alias("name"))
    h = tree(spark, d)
    asked = kept(calls.select("name").distinct())
    return replay.tool_answers(calls, h.parents(asked), h.children_by_edge(asked), h.nodes.join(asked, "name", "left_semi"), ",")


@query(
    """, c AS (SELECT 'part' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'NATION_' || (p_partkey % 25) ELSE (SELECT f.parent FROM dag_first f WHERE f.name = 'part' || p_partkey) END AS ancestor, p_partkey % 3 <> 0 AS is_ancestor FROM part)
    SELECT c.name, c.ancestor, c.is_ancestor, (EXISTS (SELECT 1 FROM dag_chain x WHERE x.name = c.name AND x.ancestor = c.ancestor)) = c.is_ancestor AS valid FROM c WHERE c.ancestor IS NOT NULL""",
    "dag_chain",
)
def a2_validation(spark: SparkSession, d: str) -> DataFrame:
    """F19."""
    h = dag(spark, d)
    p = tables.read(spark, d, "part").select(F.concat(F.lit("part"), "p_partkey").alias("name"), "p_partkey").join(h.first_parent(), "name", "left")
    claims = p.select("name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("NATION_"), F.col("p_partkey") % 25)).otherwise(F.col("parent")).alias("ancestor"), (F.col("p_partkey") % 3 != 0).alias("is_ancestor"))
    return validate.a2_valid(claims.where("ancestor is not null"), h.ancestors()).select("name", "ancestor", "is_ancestor", "valid")


@query(
    """, c AS (SELECT 'NATION_' || n_nationkey AS name FROM nation), t AS (SELECT c.name AS target, x.target AS item, 1 AS tier FROM c JOIN tree x ON x.source = c.name UNION ALL SELECT c.name, n.name, 2 FROM c, tree_nodes n WHERE n.name LIKE 'NATION%'),
    b AS (SELECT target, item, min(tier) AS tier FROM t GROUP BY ALL) SELECT target, item, tier, CAST(row_number() OVER (PARTITION BY target ORDER BY tier, md5(concat_ws('|', 's', target, item)), item) AS INTEGER) AS place FROM b QUALIFY place <= 6""",
    "tree_nodes",
)
def tiered_fill(spark: SparkSession, d: str) -> DataFrame:
    """Lower tiers first, by hash within one."""
    h = tree(spark, d)
    c = tables.read(spark, d, "nation").select(F.col("n_name").alias("target"))
    one = h.edges.select(F.col("source").alias("target"), F.col("target").alias("item")).join(c, "target").withColumn("tier", F.lit(1))
    two = c.crossJoin(F.broadcast(c.select(F.col("target").alias("item")))).withColumn("tier", F.lit(2))  # a fixed table of 25 rows
    return ordering.tiered(one.unionByName(two), ["target"], "item", 6, "s")
