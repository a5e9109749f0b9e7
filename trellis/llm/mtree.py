"""Exact top-k by inner product: best-first search of an M-tree.

Vectors become whole numbers (floor of 256 times each component). Within a shell (lengths of one power of two) one more
component fills all vectors up to the longest, which turns inner product into distance: the largest product is the
nearest vector, and the triangle inequality holds. A vector of another order of size has a shell of its own and
spoils no other bounds. The tree of a shell has three levels of nodes: ``ROUTES`` routing objects from a bounded
sample by hash, under each the objects whose nearest it is, and under each of these leaf pages of ``PAGE`` entries;
every node has a centre, a covering radius and the distance of its centre to its parent's, every entry its distance
to the page's centre. Members of an object are split in groups of about ``GROUP`` by a hash, each with its own pages.

A query starts from the k-th best of the sample. It goes down the inner nodes: those that the stored parent
distance excludes cost no distance. For each group that is left it keeps the pages in a heap by their least possible
distance, opens the best first, skips entries by the same inequality, and ends when no page can improve on its k-th
best. Products are exact whole numbers of any size; bounds carry a margin for rounding, and one that isn't a number
excludes nothing.

Queries are the rows with every ``EVERY``-th id, a stated query set against all rows. Queries go to the groups; a
group's pages are copied for each ``BLOCK`` queries that it has. Collected are a number for each inner node and the
sample, both of bounded size, nothing for groups or rows.

Nulls: a vector that is null, empty, or has a null or non-finite component (also after multiplying by 256), and one
without an id, takes no part. Every row is a row: of several with one id each is a candidate, and each with a query's
id asks for itself and leaves out itself alone; equal scores and ids are in the order of their rows. Vectors of
different lengths are filled up with zeros. Scores beyond 64 bits are given as the nearest number of 64 bits and
ordered by their nearest double. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

GROUP, PAGE, BLOCK, ROUTES, SEEDS, EVERY = 4096, 256, 1024, 16, 2048, 50
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, q, shell): the vectors that take part, whole numbers as doubles; the shell is the power of two of the length."""
    sound = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(256D * cast(x as double)) < double('Infinity'))"
    # floor() would give a long, which a large component does not fit
    whole = "transform(embedding, x -> element_at(transform(array(256D * cast(x as double)), y -> if(abs(y) < 4.5e15D, cast(floor(y) as double), y)), 1))"
    own = embeddings.where(F.col("vec_id").isNotNull()).where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.expr(whole).alias("q"))
    top = "aggregate(q, 0D, (t, x) -> greatest(t, abs(x)))"
    length = f"log2({top}) + 0.5 * log2(aggregate(q, 0D, (t, x) -> t + pow(x / {top}, 2)))"
    return own.withColumn("shell", F.expr(f"if({top} = 0, -1, cast(floor({length}) as int))"))


def _matrix(rows, d: int) -> np.ndarray:
    rows = list(rows)
    if rows and all(len(r) == d for r in rows):
        return np.array(rows, float).reshape(len(rows), d)
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _filled(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, that makes all vectors as long as the longest; ``longest`` is a square."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def products(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of the rows of ``x`` with ``q``: as doubles, and as longs, cut at 64 bits."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if most < 2.0**53:
        s = x @ q
        return s, s.astype(np.int64)
    whole = [int(v) for v in q.tolist()]
    exact = [sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in x.tolist()]
    near = lambda v: float(v) if abs(v) < 1 << 1023 else float("inf") * (1 if v > 0 else -1)
    return np.array([near(v) for v in exact], float), np.array([min(max(v, LEAST), MOST) for v in exact], np.int64)


def _limit(square: float, longest: float, least: float) -> float:
    """The distance of a vector with the score ``least`` from a query of the length ``square``, squared; with a margin for rounding."""
    size = float(np.sqrt(square + longest))
    return float(np.sqrt(max(square + longest - 2.0 * least, 0)) * (1 + 1e-9) + 1e-3 + 1e-7 * size) if np.isfinite(size) else np.inf


@dataclass
class Shell:
    """The inner nodes of one shell; their number is bounded by the sample."""

    longest: float
    centres: np.ndarray  # of the objects, filled
    routes: np.ndarray  # of the routing objects, filled
    route_of: np.ndarray
    up: np.ndarray  # distance of an object to its routing object
    first: int = 0  # number of its first object among those of all shells
    radius: np.ndarray | None = None
    splits: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _far(_filled(x, self.longest), self.centres)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at]

    def open_objects(self, q: np.ndarray, least: float) -> np.ndarray:
        """The objects that may hold a vector with a score of ``least`` or more, by going down from the routing objects."""
        square = float(q @ q)
        limit = _limit(square, self.longest, least)
        point = np.append(q, 0.0)[None]
        to_route = _far(point, self.routes)[0]
        can = np.flatnonzero(~(np.abs(to_route[self.route_of] - self.up) - self.radius > limit) & (self.radius != -np.inf))  # that radius: no members
        to_object = _far(point, self.centres[can])[0]
        return can[~(to_object - self.radius[can] > limit)]


def _placed(shells: dict[int, Shell]):
    """Adds to each vector its object and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("shell").to_numpy()
            q = b.column("q").to_pylist()
            obj, far = np.zeros(len(own), np.int64), np.zeros(len(own))
            for s in np.unique(own):
                at = np.flatnonzero(own == s)
                k, f = shells[int(s)].nearest(_matrix([q[i] for i in at], shells[int(s)].centres.shape[1] - 1))
                obj[at], far[at] = k + shells[int(s)].first, f
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(obj), pa.array(far)], names=[*b.schema.names, "object", "far"])

    return run


def _pages(shells: dict[int, Shell], d: int):
    """The pages of one group: entries nearest to one of a few centres, cut at PAGE in order of distance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        shell = shells[int(pdf.shell[0])]
        x, e_object = _matrix(pdf.q, d), shell.centres[int(pdf.object[0]) - shell.first]
        e = _filled(x, shell.longest)
        centres = e[:: max(1, PAGE // 2)]
        far = _far(e, centres)
        near = far.argmin(axis=1)
        out = []
        for c in np.unique(near):
            own = np.flatnonzero(near == c)
            own = own[np.argsort(far[own, c], kind="stable")]
            up = float(np.linalg.norm(centres[c] - e_object))
            for k in range(0, len(own), PAGE):
                at = own[k : k + PAGE]
                out.append((pdf.object[0], pdf.part[0], pdf.shell[0], pdf.row.to_numpy()[at].tobytes(), pdf.vec_id.to_numpy()[at].tobytes(), x[at].tobytes(), centres[c].tobytes(), far[at, c].tobytes(), float(far[at, c].min()), float(far[at, c].max()), up))
        return pd.DataFrame(out, columns=["object", "part", "shell", "rows", "ids", "vectors", "centre", "entry_far", "inner", "radius", "parent_far"])

    return run


_PAGES = "object long, part long, shell int, rows binary, ids binary, vectors binary, centre binary, entry_far binary, inner double, radius double, parent_far double"


def _aimed(rows: np.ndarray, x: np.ndarray, shells: dict[int, Shell], k: int, d: int):
    """Adds to each query a score that k of the sample reach, itself not among them, and the objects that may hold one as good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors, objects = [], []
            for own, q in zip(b.column("row").to_pylist(), _matrix(b.column("q").to_pylist(), d), strict=True):
                known = products(x, q)[0][rows != own]
                floor = float(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else -np.inf
                floors.append(floor)
                objects.append(np.concatenate([s.open_objects(q, floor) + s.first for s in shells.values()]).tolist())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("q"), pa.array(floors, pa.float64()), pa.array(objects, pa.list_(pa.int64()))], names=["row", "vec_id", "q", "floor", "objects"])

    return run


class Tree:
    """The pages of one group, ready for search."""

    def __init__(self, pages: pd.DataFrame, centre: np.ndarray, longest: float, d: int):
        self.rows, self.ids = ([np.frombuffer(b, np.int64) for b in pages[c]] for c in ("rows", "ids"))
        self.vectors = [np.frombuffer(b).reshape(-1, d) for b in pages.vectors]
        self.far = [np.frombuffer(b) for b in pages.entry_far]
        self.centres = np.stack([np.frombuffer(b) for b in pages.centre])
        self.inner, self.radius, self.up = (pages[c].to_numpy() for c in ("inner", "radius", "parent_far"))
        self.centre, self.longest = centre, longest
        self.computed = 0

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> list[tuple[float, int, int, int]]:
        """The k best (score as double, score, -id, -row) for ``q``; ``floor``: a score that k vectors elsewhere are known to reach."""
        best: list[tuple[float, int, int, int]] = []
        point = np.append(q, 0.0)
        square = float(q @ q)

        def reach() -> float:
            least = max(best[0][0], floor) if len(best) == k else floor
            return np.inf if least == -np.inf else _limit(square, self.longest, least)

        to_object = float(np.sqrt(((point - self.centre) ** 2).sum()))
        low = np.maximum(np.nan_to_num(np.abs(to_object - self.up) - self.radius, nan=0.0, neginf=0.0), 0)  # no distance to a centre can be less
        open_ = np.flatnonzero(~(low > reach()))
        agenda = list(zip(low[open_].tolist(), [-1.0] * len(open_), open_.tolist(), strict=True))
        heapq.heapify(agenda)
        while agenda:
            low, to_centre, i = heapq.heappop(agenda)
            limit = reach()
            if low > limit:
                break
            if to_centre < 0:  # only now the distance itself
                to_centre = float(np.sqrt(((point - self.centres[i]) ** 2).sum()))
                heapq.heappush(agenda, (float(np.nan_to_num(max(0.0, to_centre - self.radius[i], self.inner[i] - to_centre), nan=0.0)), to_centre, i))
                continue
            can = np.flatnonzero(~(np.abs(self.far[i] - to_centre) > limit))
            self.computed += len(can)
            near, scores = products(self.vectors[i][can], q)
            ids, rows = self.ids[i][can], self.rows[i][can]
            for j in np.flatnonzero(near >= best[0][0]) if len(best) == k else range(len(can)):
                if rows[j] == own:
                    continue
                entry = (float(near[j]), int(scores[j]), -int(ids[j]), -int(rows[j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


def top_k(embeddings: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best others by inner product, ties to the smaller id."""
    schema = "query_id long, rank int, vec_id long, score long"
    spark = embeddings.sparkSession
    v = written(quantised(embeddings), "vectors")
    square = F.expr("aggregate(q, 0D, (t, x) -> t + x * x)")
    hashed = F.struct(F.xxhash64("vec_id"), "row", "q")
    facts = v.groupBy("shell").agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d"), F.max(square).alias("longest"), F.count_if(F.col("vec_id") % every == 0).alias("queries"), F.min(hashed).alias("one")).collect()  # a row for each power of two
    if not sum(r.queries for r in facts):
        return spark.createDataFrame([], schema)
    d = max(r.d for r in facts)
    sample = v.orderBy(F.xxhash64("vec_id"), "row").limit(SEEDS).select("row", "shell", "q").collect()  # SEEDS rows
    seed_rows, seed_x = np.array([r["row"] for r in sample]), _matrix([r.q for r in sample], d)
    seed_shell = np.array([r.shell for r in sample])
    shells: dict[int, Shell] = {}
    first = 0
    for r in sorted(facts, key=lambda r: r.shell):
        x = seed_x[seed_shell == r.shell][: -(-r.n // GROUP)]
        e = _filled(x if len(x) else _matrix([r.one.q], d), r.longest)
        far = _far(e, e[:ROUTES])
        route_of = far.argmin(axis=1)
        shells[r.shell] = Shell(r.longest, e, e[:ROUTES], route_of, far[np.arange(len(e)), route_of], first)
        first += len(e)
    placed = map_arrow(v, _placed(shells), "row long, vec_id long, q array<double>, shell int, object long, far double")
    nodes = {r.object: r for r in placed.groupBy("object").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row for each object, SEEDS and shells at most
    splits = np.ones(first, np.int64)
    for s in shells.values():
        own = [nodes.get(s.first + i) for i in range(len(s.centres))]
        s.radius = np.array([r.radius if r else -np.inf for r in own])
        splits[s.first : s.first + len(own)] = [-(-r.n // GROUP) if r else 1 for r in own]
    many = F.element_at(F.lit(splits.tolist()), (F.col("object") + 1).cast("int")).cast("long")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), many)).drop("far")
    pages = written(dealt.groupBy("object", "part").applyInPandas(_pages(shells, d), _PAGES), "pages")
    aimed = map_arrow(v.where(F.col("vec_id") % every == 0).select("row", "vec_id", "q"), _aimed(seed_rows, seed_x, shells, k, d), "row long, vec_id long, q array<double>, floor double, objects array<long>")
    queries = written(aimed.withColumn("object", F.explode("objects")).drop("objects"), "queries")
    blocks = queries.groupBy("object").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).alias("blocks"))
    asked = queries.join(blocks, "object").select(
        "row", "vec_id", "q", "floor", "object", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("part"), F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block")
    )
    spread = pages.join(blocks, "object").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def searched(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            s = shells[int(p["shell"].iloc[0])]
            tree = Tree(p, s.centres[int(p["object"].iloc[0]) - s.first], s.longest, d)
            for own, i, x, floor in zip(q.row.tolist(), q.vec_id.tolist(), _matrix(q.q, d), q.floor.tolist(), strict=True):
                out += [(own, i, near, score, -j, -r) for near, score, j, r in tree.search(own, x, k, floor)]
        return pd.DataFrame(out, columns=["own", "query_id", "near", "score", "vec_id", "row"]).astype({"own": "int64", "query_id": "int64", "near": "float64", "score": "int64", "vec_id": "int64", "row": "int64"})

    at = ["object", "part", "block"]
    found = asked.groupBy(*at).cogroup(spread.groupBy(*at)).applyInPandas(searched, "own long, query_id long, near double, score long, vec_id long, row long")
    order = Window.partitionBy("own").orderBy(F.desc("near"), F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.own, a.vec_id AS query_id, b.own AS other, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
