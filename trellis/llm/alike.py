"""Near copies by their five-word shingles: all pairs of texts with a Jaccard similarity of at least 0.8, exactly.

Shingles are put in one order for all texts, the rare ones first: by how many texts have a shingle of the same one of
``BUCKETS`` hash buckets, and after all others those that are seen several times in some chunk of the table, the
more the later. So shingles that unrelated texts share by chance, which are the more the larger the table is, stay out
of a text's first ones. Two sets with a similarity of at
least 0.8 have ``NEED`` shingles (or all that they must share, if these are fewer) in common among the first
n - ceil(0.8 n) + NEED of each, so texts that share fewer of those are no pair (the order decides how many candidates
there are, never which pairs are found). SimHash groups come first; then, among the texts that share such shingles,
each is held against one of ``HUBS`` that a hash picks, which connects most of a large group, and after that against
all of other groups than its own. Before each of these passes shingles go that a text shares with no text of another
group and of a size that allows 0.8, and texts that have fewer than ``NEED`` left, for no pair needs them; so whole
sets are moved of texts with a likely partner alone. Where at most ``SMALL`` texts share a shingle as pairs, and else in cells. A cell has
all texts of the shingles that have one hub, compares their whole sets in blocks of ``CELL``, and hands on a spanning
forest of links, so that no pairs of a large group are made. Every candidate is verified by the whole sets. These are
moved once for each pair or block that needs them, which may be many times the input; so pairs and blocks are dealt out
in waves that move at most about ``PAIRS`` pairs' sets, or ``MOVED`` bytes and ``ROWS`` rows of blocks, and one wave's shuffles
go before the next. Links connect groups, so pairs within one are not needed.

Words are those of ``simhash.fingerprint``: cut at white space, A-Z as a-z; a text of at most five words is one shingle.
Nulls: a null text is an empty one, without shingles. Repeated rows count once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, map_arrow, whole_text, written
from .components import components, forest
from .simhash import first_of_groups, near_roots

WORDS = 5
#: Shingles that are counted at a time; how many of the most common are put last, which bounds what is collected.
CHUNK, COMMON = 1 << 21, 1 << 17
#: Times that a shingle must be seen to be called common.
OFTEN = 3
#: Hash buckets in which texts are counted for all shingles, two bytes each, and the parts that they are added up in.
BUCKETS, PARTS = 1 << 22, 64
#: Texts of a large group that all others are held against before all pairs of what is still apart are.
HUBS = 4
#: Texts of one shingle that are compared as pairs; texts of a cell that one task compares with as many others.
SMALL, CELL = 8, 1_000
#: Shingles of a cell's texts that one task compares with as many others, on average.
SHINGLES = 1 << 20
#: Pairs that are verified at a time; bytes and rows of whole sets that go to blocks of cells at a time.
PAIRS, MOVED, ROWS = 1 << 18, 1 << 31, 1 << 20
#: Shingles that a pair must share among its first ones.
NEED = 3


def shingles(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        found = [h(line)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-words_each].tolist()]
        found = [h(line[s:e]) for s, e in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def _first_shingles(common: np.ndarray, weight: np.ndarray, rarity: np.ndarray):
    """Rows (token, key, n): of each text as many shingles as a pair must share NEED of; common in order, with weights; the others by their buckets' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, keys, sizes = [], [], []
            for key, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                s = shingles(t.as_py())
                n = len(s)
                if not n:
                    continue
                w = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    w = np.where(common[at] == s, weight[at], 0)
                s = s[np.lexsort((s, rarity[s & (BUCKETS - 1)], w))][: n - (4 * n + 4) // 5 + NEED]
                tokens.append(s)
                keys.append(np.full(len(s), key, np.int64))
                sizes.append(np.full(len(s), n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes)], names=["token", "key", "n"])

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingles(t.as_py()) for t in b.column("text")], pa.list_(pa.int64()))], names=["key", "s"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n): shingles that several different texts of a chunk have, and how many."""
    held, size, keys = [], 0, set()

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1]), pa.array(n[n > 1])], names=["token", "n"])

    for b in batches:
        for key, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            if key in keys:
                continue
            keys.add(key)
            held.append(shingles(t.as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield counted()
                held, size, keys = [], 0, set()
    yield counted()


def _most_common(texts: DataFrame) -> np.ndarray:
    """(token, n), by token, of the shingles seen most often: all that are seen as often as a limit, which the histogram of
    counts puts where at most ``COMMON`` are; so no more than these go to the driver, however many tasks there are."""
    often = written(map_arrow(texts, _often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "often")
    # eight steps to each doubling, so that the histogram has some hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    many = sorted(often.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect(), reverse=True)
    least, total = None, 0
    for r in many:
        total += r.c
        if total > COMMON:
            break
        least = r.step
    found = often.where(step >= least).collect() if least is not None else []
    dropped(often)
    return np.array(sorted((r.token, r.n) for r in found), np.int64).reshape(-1, 2)


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, n): the numbers of a task's different texts that have a shingle of each bucket, cut in PARTS."""
    total, held, size, keys = np.zeros(BUCKETS, np.uint32), [], 0, set()

    def add() -> None:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        total[at] += n.astype(np.uint32)

    for b in batches:
        for key, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            if key in keys:
                continue
            keys.add(key)
            held.append(shingles(t.as_py()) & (BUCKETS - 1))
            size += len(held[-1])
            if size >= CHUNK >> 3:
                add()
                held, size, keys = [], 0, set()
    if held:
        add()
    yield _parts(range(PARTS), total.reshape(PARTS, -1))


def _parts(part: Iterable[int], n: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([np.minimum(x, 0xFFFF).astype("<u2").tobytes() for x in n], pa.binary())], names=["part", "n"])


def _parts_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, n in zip(b.column("part").to_pylist(), b.column("n"), strict=True):
            n = np.frombuffer(n.as_buffer(), "<u2")
            total[part] = total[part] + n if part in total else n.astype(np.int64)
    if total:
        yield _parts(list(total), total.values())


def _rarity(texts: DataFrame) -> np.ndarray:
    """For each bucket how many texts have a shingle of it, 65,535 at most: a table of one size whatever is counted, which goes to the driver and the tasks."""
    rows = map_arrow(map_arrow(texts, _in_buckets, "part int, n binary").repartition("part"), _parts_added, "part int, n binary").collect()
    found = np.zeros((PARTS, BUCKETS // PARTS), np.uint16)
    for r in rows:
        found[r.part] = np.frombuffer(r.n, "<u2")
    return found.ravel()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of the first one, never cut within one of its values."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, key, n) in order, each once, those whose token several keys have."""
    for token, key, n in _groups(batches):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n = token[new], key[new], n[new]
        _, at, many = np.unique(token, return_inverse=True, return_counts=True)
        ok = many[at] > 1
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (token, key, n)], names=["token", "key", "n"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, root, key, n) in order of the token, those whose token a text of another root has, of a size that allows 0.8."""
    for token, root, key, n in _groups(batches):
        by = np.lexsort((root, n, token))
        token, root, key, n = token[by], root[by], key[by], n[by].astype(np.int64)
        _, group = np.unique(token, return_inverse=True)
        top = int(n.max()) + 1
        at = group * top + n
        low = np.searchsorted(at, group * top + (4 * n + 4) // 5, side="left")
        high = np.searchsorted(at, group * top + np.minimum(5 * n // 4, top - 1), side="right")
        new = np.append(True, (token[1:] != token[:-1]) | (root[1:] != root[:-1]))
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        ok = (low < starts[run]) | (high > np.append(starts[1:], len(token))[run])
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[ok]), pa.array(root[ok]), pa.array(key[ok]), pa.array(n[ok].astype(np.int32))], names=["token", "root", "key", "n"])


def _hubs(token: np.ndarray, key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row of a token's group the row that is its hub: the least hash of a key under one of HUBS seeds, so that groups of the same texts have the same ones."""
    with np.errstate(over="ignore"):
        h = (key.view(np.uint64) ^ (token.view(np.uint64) % np.uint64(HUBS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    starts = np.unique(begin)
    by = np.lexsort((h, begin))
    return by[starts][np.searchsorted(starts, begin)]


def _candidates(with_hub: bool, block: int = 1 << 18):
    """Pairs (a, b) of keys with one token, different roots and sizes that allow 0.8: of rows (token, root, key, n) in order, each with the hub or, of at most SMALL, all.

    With how many tokens they were found by, and how many they must be found by.
    """

    def pairs(i: np.ndarray, j: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        ok = 4 * np.maximum(n[i], n[j]) <= 5 * np.minimum(n[i], n[j])
        i, j = i[ok], j[ok]
        need = np.minimum(NEED, (4 * np.maximum(n[i], n[j]) + 4) // 5)
        return summed(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), need, np.ones(len(i), np.int64)]))

    def summed(rows: np.ndarray) -> np.ndarray:
        both, at = np.unique(rows[:3], axis=1, return_inverse=True)
        return np.vstack([both, np.bincount(at.ravel(), weights=rows[3], minlength=both.shape[1]).astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair that several shingles of a partition have is one row, as far as a buffer goes."""
        held, size = [], 0
        for found in found_in(batches):
            held.append(found)
            size += found.shape[1]
            if size > block:
                held = [summed(np.hstack(held))]
                size = held[0].shape[1]
                if size > block // 2:
                    yield batch(held[0])
                    held, size = [], 0
        if size:
            yield batch(summed(np.hstack(held)))

    def batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in (0, 1, 3, 2)], names=["a", "b", "many", "need"])

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for token, root, key, n in _groups(batches):
            n = n.astype(np.int64)
            begin, end = (np.searchsorted(token, token, side=s) for s in ("left", "right"))
            if with_hub:
                hub = _hubs(token, key, begin)
                j = np.flatnonzero(root != root[hub])
                yield pairs(hub[j], j, key, n)
                continue
            edge = np.flatnonzero(np.append((token[1:] != token[:-1]) | (root[1:] != root[:-1]), True)) + 1 if len(token) else np.empty(0, np.int64)
            other = edge[np.searchsorted(edge, np.arange(len(token)), side="right")]  # where the next root begins
            many = np.where(end - begin > SMALL, 0, end - other)
            reach = np.concatenate([[0], np.cumsum(many)])
            k = 0
            while k < len(token):
                m = max(k + 1, int(np.searchsorted(reach, reach[k] + block, side="right")) - 1)
                i = np.repeat(np.arange(k, m), many[k:m])
                j = other[i] + np.arange(len(i)) - np.repeat(reach[k:m] - reach[k], many[k:m])
                if len(i):
                    yield pairs(i, j, key, n)
                k = m

    return run


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, key, n): the texts of shingles that more than SMALL have, of several roots, by the shingle's hub."""
    for token, root, key, n in _groups(batches):
        begin, end = (np.searchsorted(token, token, side=s) for s in ("left", "right"))
        if not len(token):
            continue
        ok = (end - begin > SMALL) & (root[begin] != root[end - 1])  # roots are in order
        both = np.unique(np.stack([key[_hubs(token, key, begin)][ok], key[ok], n[ok].astype(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in both], names=["hub", "key", "n"])


def similar_sets(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Which of the sets have a similarity of at least 0.8, as a matrix."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    token, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), n)
    again = many[at] > 1
    _, at = np.unique(at[again], return_inverse=True)
    who = who[again]
    by = np.argsort(at, kind="stable")
    at, who = at[by], who[by]
    same = np.zeros((m, m), np.float32)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        x, z = np.searchsorted(at, [k, k + columns])
        has = np.zeros((m, columns), np.float32)
        has[who[x:z], at[x:z] - k] = 1
        same += has @ has.T
    similar = np.empty((m, m), bool)
    for k in range(0, m, 256):  # in integers, a few rows at a time
        similar[k : k + 256] = 9 * same[k : k + 256].astype(np.int64) >= 4 * (n[k : k + 256, None] + n[None, :])
    return similar


def _cells_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of roots, of rows (cell, root, s) in order of the cell."""
    held: list[tuple[int, np.ndarray]] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        root = np.array([r for r, _ in held], np.int64)
        i, j = np.nonzero(np.triu(similar_sets([s for _, s in held]) & (root[:, None] != root[None, :])))
        if len(i):
            a, b = forest(root[i], root[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        s = batch.column("s")
        for k, (cell, root) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("root").to_pylist(), strict=True)):
            if cell != last and held:
                yield from done()
                held = []
            last = cell
            held.append((root, s[k].values.to_numpy()))
    if held:
        yield from done()


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, s): the whole sets of the texts of ``keys`` (key, each once), once each; a wave has few enough keys to send them all, so that no text is moved to find its own."""
    return map_arrow(texts.join(F.broadcast(keys), "key", "left_semi"), _whole_sets, "key long, s array<long>").dropDuplicates(["key"])


def _in_waves(waves: int, rows: DataFrame, found: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``found`` makes of the rows of each ``wave`` from 0, together; the shuffles of a wave go before the next."""
    tables = []
    for k in range(waves):
        freed(rows.sparkSession)
        tables.append(written(found(rows.where(F.col("wave") == k).drop("wave")), name))
    return reduce(DataFrame.unionByName, tables)


def _linked_in_cells(placed: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between roots of texts that meet in a cell."""
    cells = written(map_arrow(placed, _in_cells, "hub long, key long, n long").distinct(), "cells")
    freed(texts.sparkSession)
    sizes = cells.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = written(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("rows") / F.lit(float(CELL))), F.ceil(F.col("shingles") / F.lit(float(SHINGLES))))), "blocks")
    moved = blocks.agg(*(F.coalesce(F.sum(F.col(c) * F.col("blocks")), F.lit(0)) for c in ("rows", "shingles"))).first()
    waves = max(1, -(-moved[0] // ROWS), -(-8 * moved[1] // MOVED))
    to_blocks = (
        cells.join(blocks.select("hub", "blocks"), "hub")
        .withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.xxhash64("hub", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))
        .withColumn("wave", F.pmod(F.xxhash64("cell"), F.lit(waves)))
    )

    def found(members: DataFrame) -> DataFrame:
        met = members.join(roots, "key").join(_sets(texts, members.select("key").distinct()), "key").select("cell", "root", "s")
        return map_arrow(met.repartition("cell").sortWithinPartitions("cell"), _cells_compared, "a long, b long")

    return _in_waves(waves, to_blocks, found, "compared")


def _verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``found`` (a, b, many, need) that were found often enough and whose shingle sets have a similarity of at least 0.8."""
    pairs = written(found.groupBy("a", "b").agg(F.sum("many").alias("many"), F.max("need").alias("need")).where("many >= need").select("a", "b"), "candidates")
    waves = max(1, -(-pairs.count() // PAIRS))

    def similar(some: DataFrame) -> DataFrame:
        keys = written(some.select(F.col("a").alias("key")).union(some.select("b")).distinct(), "keys")
        sets = _sets(texts, keys)  # one shuffle serves both joins
        both = some.join(sets.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
        same = F.size(F.array_intersect("x", "y"))
        return both.where(5 * same >= 4 * (F.size("x") + F.size("y") - same)).select("a", "b")

    alike = _in_waves(waves, pairs.withColumn("wave", F.pmod(F.xxhash64("a"), F.lit(waves))), similar, "similar")
    dropped(pairs)
    return alike


def _met(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (token, key, n) of ``shared`` that may lead to a link between roots."""
    placed = shared.join(roots, "key").select("token", "root", "key", "n").repartition("token").sortWithinPartitions("token")
    met = written(map_arrow(placed, _meeting, "token long, root long, key long, n int").select("token", "key", "n"), "met")
    enough = met.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= F.least(F.lit(NEED), F.floor((4 * F.col("n") + 4) / 5))).select("key")
    kept = written(met.join(enough, "key", "left_semi"), "meeting")
    dropped(met)
    return kept


def _linked(shared: DataFrame, roots: DataFrame, texts: DataFrame, with_hub: bool) -> DataFrame:
    """(a, b): links between roots of ``roots`` (key, root), some of them repeated."""
    placed = shared.join(roots, "key").select("token", "root", "key", "n").repartition("token").sortWithinPartitions("token", "root", "key")
    pairs = _verified(map_arrow(placed, _candidates(with_hub), "a long, b long, many long, need long"), texts)
    freed(texts.sparkSession)
    of = lambda c: roots.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return found if with_hub else found.unionByName(_linked_in_cells(placed, roots, texts))


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (key, root) after groups are joined by links."""
    to = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(to, "root", "left").select("key", F.coalesce("to", "root").alias("root")), "roots")


def near_groups_of_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_key) as of ``simhash.near_groups``, and (key, root): the group of each text key."""
    rows, found = near_roots(docs)
    freed(docs.sparkSession)
    roots = written(rows.select("fp", "text_key").distinct().join(found.withColumnRenamed("node", "fp"), "fp", "left").select(F.col("text_key").alias("key"), F.coalesce("root", "fp").alias("root")), "roots")
    texts = docs.select(F.xxhash64(whole_text()).alias("key"), whole_text().alias("text"))
    order = _most_common(texts)
    rarity = _rarity(texts)
    freed(docs.sparkSession)
    first = map_arrow(texts, _first_shingles(order[:, 0].copy(), order[:, 1].copy(), rarity), "token long, key long, n int")
    shared = written(map_arrow(first.repartition("token").sortWithinPartitions("token", "key"), _shared, "token long, key long, n int"), "shared")
    for with_hub in (True, False):
        freed(docs.sparkSession)
        met = _met(shared, roots)  # the second pass goes on from what the first one left: groups only grow
        dropped(shared)
        shared = met
        roots = _moved(roots, _linked(shared, roots, texts, with_hub))
    dropped(shared)
    freed(docs.sparkSession)
    return rows, roots


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, as of ``simhash.one_of_each_group``, where groups are linked by similar shingles as well."""
    rows, roots = near_groups_of_texts(docs)
    return first_of_groups(docs, rows.join(roots.withColumnRenamed("key", "text_key"), "text_key"))
