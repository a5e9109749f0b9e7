"""A labelled hierarchy as two tables, and what one asks of it.

``nodes`` is (name, ord), ``edges`` is (source, target, path_type, eid); ``ord`` keeps the order in which nodes were
given, which decides who the first parent is. All answers are tables for all nodes or for a table of pairs. Nothing is
bounded in depth: closures double the length of their walks with each join until nothing is new, distances relax what
got nearer, and each round is a table in the shared folder, so that no plan holds more than one. Walks end where they
would meet a node again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..steps import dropped, kept, replaced

#: Weights of the kinds of edges, the same in both directions.
WEIGHTS = {"sub-category": 1.0, "cross-descriptions": 10.0, "synonym": 0.5, "related": 5.0}


class Hierarchy:
    def __init__(self, nodes: DataFrame, edges: DataFrame, root: str):
        self.nodes, self.edges, self.root = nodes, edges, root
        self._chain: DataFrame | None = None
        self._forest: bool | None = None

    # Changes give new hierarchies.
    def with_node(self, name: str, order: int) -> Hierarchy:
        new = self.nodes.sparkSession.createDataFrame([(name, order)], "name string, ord long")
        return Hierarchy(self.nodes.where(F.col("name") != name).unionByName(new), self.edges, self.root)

    def without_node(self, name: str) -> Hierarchy:
        return Hierarchy(self.nodes.where(F.col("name") != name), self.edges.where((F.col("source") != name) & (F.col("target") != name)), self.root)

    def with_edge(self, source: str, target: str, path_type: str, eid: int) -> Hierarchy:
        if path_type not in WEIGHTS:
            raise ValueError(f"path type {path_type!r} is none of {sorted(WEIGHTS)}")
        new = self.edges.sparkSession.createDataFrame([(source, target, path_type, eid)], "source string, target string, path_type string, eid long")
        return Hierarchy(self.nodes, self.edges.unionByName(new), self.root)

    def without_edge(self, a: str, b: str) -> Hierarchy:
        s, t = F.col("source"), F.col("target")
        return Hierarchy(self.nodes, self.edges.where(~(((s == a) & (t == b)) | ((s == b) & (t == a)))), self.root)

    def parents(self, of: DataFrame | None = None) -> DataFrame:
        """(name, parents): all parents in node order; with ``of`` (name) of those names alone, whose edges become a table first, so that a few names don't shuffle all nodes."""
        n, e = self.nodes.select(F.col("name").alias("source"), "ord"), self.edges
        if of is not None:
            e = kept(e.join(of.select(F.col("name").alias("target")), "target", "left_semi"))
            n = n.join(e.select("source"), "source", "left_semi")
        n = n.groupBy("source").agg(F.min("ord").alias("ord"))  # an edge counts once, however many nodes share its source's name
        got = e.join(n, "source").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("p"))
        return got.select(F.col("target").alias("name"), F.col("p.source").alias("parents"))

    def children(self) -> DataFrame:
        n = self.nodes.select(F.col("name").alias("target"), "ord")
        got = self.edges.join(n, "target").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("c"))
        return got.select(F.col("source").alias("name"), F.col("c.target").alias("children"))

    def children_by_edge(self, of: DataFrame | None = None) -> DataFrame:
        """(name, children): an entry for each edge, in the order of edges; children that share a name are not matched with each other. With ``of`` (name) those names alone."""
        e = self.edges if of is None else self.edges.join(of.select(F.col("name").alias("source")), "source", "left_semi")
        got = e.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("eid", "target"))).alias("c"))
        return got.select(F.col("source").alias("name"), F.col("c.target").alias("children"))

    def first_parent(self) -> DataFrame:
        """(name, parent): of several parents the one that comes first in node order."""
        n = self.nodes.select(F.col("name").alias("source"), "ord")
        return self.edges.join(n, "source").groupBy("target").agg(F.min_by("source", F.struct("ord", "source")).alias("parent")).select(F.col("target").alias("name"), "parent")

    def ancestors(self) -> DataFrame:
        """(name, ancestor, dist): the chain of first parents, nearest first; on a cycle each ancestor once and not the node itself.

        Chains of up to k steps are carried on by the chains of their k-th ancestors, so that rounds are the logarithm
        of the depth.
        """
        if self._chain is not None:
            return self._chain
        known = kept(self.first_parent().where("name <> parent").select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")))
        reach = 1
        while not (far := known.where(F.col("dist") == reach)).isEmpty():
            on = far.select("name", F.col("ancestor").alias("at")).join(known.select(F.col("name").alias("at"), "ancestor", "dist"), "at")
            known = replaced(known.unionByName(on.select("name", "ancestor", (F.col("dist") + reach).alias("dist"))), known)
            if not known.where("name = ancestor").isEmpty():  # a cycle: the shortest way to each
                known = replaced(known.where("name <> ancestor").groupBy("name", "ancestor").agg(F.min("dist").alias("dist")), known)
            reach *= 2
        self._chain = known
        return known

    def depth(self) -> DataFrame:
        """(name, depth): length of the chain of first parents."""
        return self.nodes.select("name").join(self.ancestors().groupBy("name").agg(F.max("dist").alias("depth")), "name", "left").fillna(0, ["depth"])

    def descendants(self, name: str | None = None) -> DataFrame:
        """(name, descendant): all that is reached by edges, over every parent; a node on a cycle reaches itself."""
        e = self.edges.select(F.col("source").alias("name"), F.col("target").alias("descendant")).distinct()
        known = kept(e if name is None else e.where(F.col("name") == name))
        new = kept(known)
        while not new.isEmpty():
            # what the new ones lead to: by all known ways or, from one node, by edges
            further = (known if name is None else e).select(F.col("name").alias("at"), F.col("descendant").alias("next"))
            on = new.join(further, new.descendant == further["at"]).select("name", F.col("next").alias("descendant")).distinct()
            former, new = new, kept(on.join(known, ["name", "descendant"], "left_anti"))
            known = replaced(known.unionByName(new), known, former)
        dropped(new)
        return known

    def subgraph(self, name: str) -> Hierarchy:
        """The hierarchy that ``name`` and its descendants induce."""
        keep = self.descendants(name).select(F.col("descendant").alias("name")).unionByName(self.nodes.where(F.col("name") == name).select("name")).distinct()
        edges = self.edges.join(keep.withColumnRenamed("name", "source"), "source", "left_semi").join(keep.withColumnRenamed("name", "target"), "target", "left_semi")
        return Hierarchy(self.nodes.join(keep, "name", "left_semi"), edges, name)

    def root_categories(self) -> DataFrame:
        return self.edges.where(F.col("source") == self.root).select(F.col("target").alias("name")).distinct()

    def leaves(self) -> DataFrame:
        """Nodes with no children; isolated ones count."""
        return self.nodes.join(self.edges.select(F.col("source").alias("name")), "name", "left_anti").select("name")

    def middles(self) -> DataFrame:
        """Nodes with parents and children, without the root."""
        has_child = self.edges.select(F.col("source").alias("name"))
        has_parent = self.edges.select(F.col("target").alias("name"))
        return self.nodes.join(has_child, "name", "left_semi").join(has_parent, "name", "left_semi").where(F.col("name") != self.root).select("name")

    def root_category(self, strict: bool = False) -> DataFrame:
        """(name, category): the root category above each node; null for root categories themselves, unless ``strict``, and for the root."""
        cats = self.root_categories().withColumnRenamed("name", "ancestor")
        chain = self.ancestors()
        if strict:
            chain = chain.unionByName(self.nodes.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("dist")))
        got = chain.join(cats, "ancestor").groupBy("name").agg(F.max_by("ancestor", "dist").alias("category"))
        return self.nodes.select("name").join(got, "name", "left")

    def root_categories_of_parents(self) -> DataFrame:
        """(name, categories): the root categories above every direct parent, sorted."""
        of = self.root_category().where(F.col("category").isNotNull()).select(F.col("name").alias("source"), "category")
        return self.edges.join(of, "source").groupBy("target").agg(F.array_sort(F.collect_set("category")).alias("categories")).withColumnRenamed("target", "name")

    def chain_with_self(self) -> DataFrame:
        """(name, ancestor, dist): the chains, and each name once as its own at 0, however many rows of ``nodes`` have it."""
        return self.ancestors().unionByName(self.nodes.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("dist")).distinct())

    def lca(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with lca: the nearest common node of the chains, the nodes themselves among them."""
        c = self.chain_with_self()
        a = c.select(F.col("name").alias("a"), "ancestor", F.col("dist").alias("da"))
        b = c.select(F.col("name").alias("b"), "ancestor", F.col("dist").alias("db"))
        got = pairs.join(a, "a").join(b, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", "da").alias("lca"), F.min(F.col("da") + F.col("db")).alias("hops"))
        return pairs.join(got, ["a", "b"], "left")

    def common_ancestors(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ancestor): ancestors of both but the root."""
        c = self.ancestors().where(F.col("ancestor") != self.root)
        return pairs.join(c.select(F.col("name").alias("a"), "ancestor"), "a").join(c.select(F.col("name").alias("b"), "ancestor"), ["b", "ancestor"]).select("a", "b", "ancestor")

    def both_ways(self) -> DataFrame:
        """Edges with their reverse ones: (source, target, path_type, weight)."""
        e = self.weighed()
        return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "path_type", "weight"))

    def weighed(self) -> DataFrame:
        """Edges with their weights; kinds without one are refused."""
        unknown = self.edges.where(F.col("path_type").isNull() | ~F.col("path_type").isin(list(WEIGHTS))).select("path_type").limit(1).collect()
        if unknown:
            raise ValueError(f"edges of type {unknown[0].path_type!r} have no weight; there are {sorted(WEIGHTS)}")
        w = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("path_type"))
        return self.edges.select("source", "target", "path_type", w.alias("weight"))

    def _steps(self, weighted: bool, reverse: bool) -> DataFrame:
        """(at, next, w): the cheapest step from a node to another; without weights each is one."""
        if weighted:
            e = self.both_ways() if reverse else self.weighed()
        else:
            e = self.edges.select("source", "target")
            e = (e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))) if reverse else e).withColumn("weight", F.lit(1.0))
        return e.groupBy(F.col("source").alias("at"), F.col("target").alias("next")).agg(F.min("weight").alias("w"))

    def distances(self, sources: DataFrame, weighted: bool = False, reverse: bool = True, max_hops: int | None = None) -> DataFrame:
        """(source, name, distance): the least number of hops, or sum of weights, from each row of ``sources`` (name).

        Where every node has one parent at most and there is no cycle, a distance is the sum of the ways up to the nearest
        common ancestor, without rounds, however deep. Elsewhere relaxation goes in rounds over the pairs that got
        nearer, until none does. Pairs that are missing have no path (of ``max_hops``, where that is given); ``distance_of``
        has infinity for them.
        """
        start = sources.select(F.col("name").alias("source"), "name", F.lit(0.0).alias("distance")).distinct()
        if self.is_forest():
            return self._distances_by_chains(start.select("source"), weighted, reverse, max_hops).unionByName(start.join(self.nodes.select("name"), "name", "left_anti").select("source", "name", "distance"))
        e = kept(self._steps(weighted, reverse))
        known, new = kept(start), kept(start)
        hops = 0
        while (max_hops is None or hops < max_hops) and not new.isEmpty():
            further = new.join(e, new.name == e["at"]).groupBy("source", F.col("next").alias("name")).agg(F.min(F.col("distance") + F.col("w")).alias("distance"))
            old = known.select("source", "name", F.col("distance").alias("_old"))
            new = replaced(further.join(old, ["source", "name"], "left").where("_old is null or distance < _old").drop("_old"), new)
            known = replaced(known.join(new, ["source", "name"], "left_anti").unionByName(new), known)
            hops += 1
        dropped(e, new)
        return known

    def is_forest(self) -> bool:
        """Whether every node has one parent at most, all ends of edges are nodes, and there is no cycle."""
        if self._forest is None:
            e = self.edges.select("source", "target").distinct()
            many = e.agg(F.count("*").alias("e"), F.count_distinct("target").alias("t")).first()
            ends = e.select(F.col("source").alias("name")).unionByName(e.select(F.col("target").alias("name")))
            self._forest = many.e == many.t and ends.join(self.nodes.select("name"), "name", "left_anti").isEmpty() and self.is_dag().first().nodes_left == 0
        return self._forest

    def _distances_by_chains(self, sources: DataFrame, weighted: bool, reverse: bool, max_hops: int | None) -> DataFrame:
        up = self.chain_with_self()
        if weighted:
            w = self._steps(True, False).groupBy(F.col("next").alias("ancestor")).agg(F.min("w").alias("w"))  # the one edge into a node
            deep = up.join(w, "ancestor", "left").groupBy("name").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("_deep"))
            up = up.join(deep, "name").join(deep.select(F.col("name").alias("ancestor"), F.col("_deep").alias("_top")), "ancestor").withColumn("far", F.col("_deep") - F.col("_top")).drop("_deep", "_top")
        else:
            up = up.withColumn("far", F.col("dist").cast("double"))
        a = up.select(F.col("name").alias("source"), "ancestor", F.col("dist").alias("da"), F.col("far").alias("fa")).join(sources.distinct(), "source", "left_semi")
        if not reverse:
            a = a.where("da = 0")  # down from the source alone
        both = a.join(up, "ancestor").groupBy("source", "name").agg(F.min(F.col("fa") + F.col("far")).alias("distance"), F.min(F.col("da") + F.col("dist")).alias("hops"))
        return (both if max_hops is None else both.where(F.col("hops") <= max_hops)).select("source", "name", "distance")

    def distance_of(self, pairs: DataFrame, weighted: bool = False, reverse: bool = True) -> DataFrame:
        """``pairs`` (a, b) with distance: infinity where no path leads from a to b."""
        far = self.distances(pairs.select(F.col("a").alias("name")), weighted, reverse)
        got = pairs.join(far.select(F.col("source").alias("a"), F.col("name").alias("b"), "distance"), ["a", "b"], "left")
        return got.fillna(float("inf"), ["distance"])

    def paths(self, pairs: DataFrame, k: int, reverse: bool = True, weighted: bool = False, max_hops: int | None = None) -> DataFrame:
        """(a, b, rank, path, cost): the k cheapest simple paths; ties by hops, then by the path itself.

        Paths grow from the side of the pairs that has more different ends (each end's paths serve all its pairs), a
        step in each round, until none is open; one that costs more than the k-th found of all its pairs is closed.
        """
        ends = pairs.select("a", "b").distinct()
        n = ends.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
        back = n.b > n.a
        e = self._steps(weighted, reverse)
        e = kept(e.select(F.col("next").alias("at"), F.col("at").alias("next"), "w") if back else e)
        asked = kept(ends.select(*(F.col(c).alias(x) for c, x in zip(("b", "a") if back else ("a", "b"), ("start", "end"), strict=True))))
        open_ = asked.select("start", F.col("start").alias("end"), F.array("start").alias("path"), F.lit(0.0).alias("cost")).distinct()
        done, hops = open_.join(asked, ["start", "end"]), 0
        tables: list[DataFrame] = []
        while True:
            done = replaced(done, *tables)
            kth = asked.join(done, ["start", "end"], "left").groupBy("start", "end").agg(F.array_sort(F.collect_list("cost")).alias("c"))  # a few for each pair
            most = kth.groupBy("start").agg(F.max(F.when(F.size("c") >= k, F.get("c", F.lit(k - 1))).otherwise(float("inf"))).alias("most"))
            further = kept(
                open_.join(e, open_["end"] == e["at"])
                .where(~F.array_contains("path", F.col("next")))
                .select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"))
                .join(most, "start")
                .where("cost <= most")
                .drop("most")
            )
            hops += 1
            tables = [done, *([open_] if hops > 1 else [])]
            open_ = further
            if open_.isEmpty():
                break
            done = self._best(done.unionByName(open_.join(asked, ["start", "end"]).select(*done.columns)), k, back).drop("rank")
            if hops == max_hops:
                break
        out = self._best(done, k, back)
        path = F.reverse("path") if back else F.col("path")
        named = out.select(*(F.col(c).alias(x) for c, x in zip(("start", "end"), ("b", "a") if back else ("a", "b"), strict=True)), "rank", path.alias("path"), "cost")
        return pairs.select("a", "b").join(named, ["a", "b"]).select("a", "b", "rank", "path", "cost")

    @staticmethod
    def _best(found: DataFrame, k: int, back: bool) -> DataFrame:
        order = Window.partitionBy("start", "end").orderBy("cost", F.size("path"), F.array_join(F.reverse("path") if back else F.col("path"), ">"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def adjacency(self, with_root: bool = True, reverse: bool = False) -> DataFrame:
        """(i, j, value): number of edges; with ``reverse`` both directions count for each edge."""
        e = self.edges.select("source", "target")
        if reverse:
            e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
            e = e.unionByName(e)  # the undirected twin holds every connection twice
        if not with_root:
            e = e.where((F.col("source") != self.root) & (F.col("target") != self.root))
        return e.groupBy(F.col("source").alias("i"), F.col("target").alias("j")).agg(F.count("*").alias("value"))

    def connection(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with path_type and direction: forward, reverse or X for none."""
        e = self.edges.groupBy("source", "target").agg(F.min_by("path_type", "eid").alias("t"))
        f = e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("t").alias("f"))
        r = e.select(F.col("source").alias("b"), F.col("target").alias("a"), F.col("t").alias("r"))
        return pairs.join(f, ["a", "b"], "left").join(r, ["a", "b"], "left").select(
            "a", "b", F.coalesce("f", "r").alias("path_type"), F.when(F.col("f").isNotNull(), "forward").when(F.col("r").isNotNull(), "reverse").otherwise("X").alias("direction")
        )

    def siblings(self) -> DataFrame:
        """(name, sibling): other nodes with the same first parent."""
        f = self.first_parent()
        return f.join(f.select("parent", F.col("name").alias("sibling")), "parent").where("name <> sibling").select("name", "sibling")

    def sibling_summary(self) -> DataFrame:
        """(name, n, first): how many siblings a node has, and the first by name; from one row for each parent, not from pairs."""
        f = self.first_parent()
        of = f.groupBy("parent").agg(F.count("*").alias("_n"), F.min("name").alias("_1"))
        second = f.join(of, "parent").where("name <> _1").groupBy("parent").agg(F.min("name").alias("_2"))
        j = f.join(of.where("_n > 1"), "parent").join(second, "parent")
        return j.select("name", (F.col("_n") - 1).alias("n"), F.when(F.col("name") == F.col("_1"), F.col("_2")).otherwise(F.col("_1")).alias("first"))

    def cousins_of_parents(self) -> DataFrame:
        """(parent, cousin): children of the siblings of a parent; its children share them all."""
        f = self.first_parent()
        uncles = self.siblings().select(F.col("name").alias("parent"), F.col("sibling").alias("uncle"))
        kids = f.select(F.col("parent").alias("uncle"), F.col("name").alias("cousin"))
        return uncles.join(kids, "uncle").select("parent", "cousin").distinct()

    def cousins(self) -> DataFrame:
        """(name, cousin): every pair, as many as there are; ``cousins_of_parents`` has them once for all children of a parent."""
        return self.first_parent().join(self.cousins_of_parents(), "parent").select("name", "cousin")

    def cousin_summary(self) -> DataFrame:
        """(name, n): how many cousins a node has: all grandchildren of its grandparent by first parents, but for its parent's."""
        f = self.first_parent()
        many = f.groupBy("parent").agg(F.count("*").alias("_own"))
        up = many.join(f.select(F.col("name").alias("parent"), F.col("parent").alias("_grand")), "parent")
        of = up.join(up.groupBy("_grand").agg(F.sum("_own").alias("_all")), "_grand").select("parent", (F.col("_all") - F.col("_own")).alias("n"))
        return f.join(of.where("n > 0"), "parent").select("name", "n")

    def is_dag(self) -> DataFrame:
        """(nodes_left): nodes that are on a cycle or below one; 0 for a DAG.

        A node with one parent is left if and only if its parent is, so each chain of such nodes counts as the node it begins at,
        which is found by doubling steps: as many joins as the logarithm of the chain. Of what remains, nodes without
        parents go, nodes that are their own parent or below a known cycle are counted, and chains are formed anew, until
        nothing changes; whoever is left then has parents among those that are left.
        """
        names = self.nodes.select("name").distinct()
        node = kept(names.withColumn("n", F.lit(1).cast("long")))
        ends = self.edges.select("source", "target").distinct().join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
        e, below = kept(ends), 0  # below: nodes known to be on or below a cycle; an edge from one of them has no source
        while not node.isEmpty():
            parents = e.groupBy("target").agg(F.count("*").alias("k"), F.min("source").alias("p"))
            single = (F.col("k") == 1) & F.col("p").isNotNull() & (F.col("p") != F.col("name"))
            head = self._heads(node.join(parents.withColumnRenamed("target", "name"), "name", "left").select("name", F.when(single, F.col("p")).otherwise(F.col("name")).alias("head")))
            whole = kept(node.join(head, "name").groupBy("head").agg(F.sum("n").alias("n")).withColumnRenamed("head", "name"))
            to = head.where("name = head").select(F.col("name").alias("target"))
            up = kept(e.join(to, "target", "left_semi").join(head.select(F.col("name").alias("source"), "head"), "source", "left").select(F.col("head").alias("source"), "target").distinct())
            on = up.where("source is null or source = target").select(F.col("target").alias("name")).distinct()
            has = up.select(F.col("target").alias("name")).distinct()
            below += whole.where("name is null").unionByName(whole.join(on, "name", "left_semi")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first().s
            left = kept(whole.where("name is not null").join(has, "name", "left_semi").join(on, "name", "left_anti"))
            target, source = F.col("target"), F.col("source")
            kept_edges = up.join(left.select(F.col("name").alias("target")), "target", "left_semi")
            still = left.select(F.col("name").alias("source"), F.lit(True).alias("_in")).unionByName(on.select(F.col("name").alias("source"), F.lit(False).alias("_in")))
            edges = kept(kept_edges.join(still, "source", "left").where("source is null or _in is not null").select(F.when(F.col("_in"), source).alias("source"), target).distinct())
            before, after = node.count(), left.count()
            dropped(head, whole, up, node, e)
            node, e = left, edges
            if before == after:
                break
        out = node.agg((F.coalesce(F.sum("n"), F.lit(0)) + below).cast("long").alias("nodes_left"))
        return out

    @staticmethod
    def _heads(pointers: DataFrame) -> DataFrame:
        """(name, head): where the chain of ``pointers`` (name, head) ends, at a node that points to itself; null on a cycle and below one that no other node leads out of."""
        at = kept(pointers)
        ends = kept(at.where("name = head").select("name"))
        most = max(at.count(), 2).bit_length() + 1
        for _ in range(most):
            open_ = at.join(ends.select(F.col("name").alias("head")), "head", "left_anti")
            if open_.isEmpty():
                dropped(ends)
                return at
            at = replaced(at.join(at.select(F.col("name").alias("head"), F.col("head").alias("_next")), "head").select("name", F.col("_next").alias("head")), at)
        out = kept(at.join(ends.select(F.col("name").alias("head"), F.lit(True).alias("_end")), "head", "left").select("name", F.when(F.col("_end"), F.col("head")).alias("head")))
        dropped(at, ends)
        return out

    def facts(self) -> DataFrame:
        """(name, ord, is_leaf, depth, parent, n_siblings): one row for each node, as filters need it."""
        leaf = self.leaves().withColumn("is_leaf", F.lit(True))
        first = self.first_parent()
        many = first.groupBy("parent").agg((F.count("*") - 1).alias("n_siblings"))
        return (
            self.nodes.join(leaf, "name", "left").fillna(False, ["is_leaf"]).join(self.depth(), "name").join(first, "name", "left").join(many, "parent", "left").fillna(0, ["n_siblings"])
        ).select("name", "ord", "is_leaf", "depth", "parent", "n_siblings")
