"""Connected components of a table of links, by alternating large and small stars.

A large star hands each link's larger node on to the smallest node near the smaller one: a grouped minimum and a join.
A small star links all smaller nodes near a node, and the node, to the smallest of them: the links are dealt out by
their larger nodes (at first in ``SALTS`` parts of each) and read in order, so no group is held. What a task has
found it hands on as a spanning forest, ``CHUNK`` links at a time, so a node has one smaller node for each of these at most, and repeated links go. None of
these steps adds links or makes the sum of their nodes larger, and only stars stay as they are. Rounds end when the links
are stars, which takes a number of rounds logarithmic in the longest chain. Each round is one written table with three
shuffles, so a lost executor costs one round at most and the driver has few stages and plans to keep account of; the
table before it is deleted. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_arrow, written

#: Links of a task that become a forest at a time.
CHUNK = 1 << 18
#: Parts in which the links of one larger node are dealt out at first.
SALTS = 64


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: each node but a component's least to that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _forests(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (hi, lo): forests of the links, ``CHUNK`` at a time."""
    held, size = [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["hi", "lo"])

    for a, b in links:
        held.append((a, b))
        size += len(a)
        if size >= CHUNK:
            yield done()
            held, size = [], 0
    if size:
        yield done()


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_numpy(), b.column(1).to_numpy()


def _small_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hi, lo) in order: each hi to its first lo, and its other ones to that."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last_hi = last_lo = least = None
        for hi, lo in _columns(batches):
            first, again = np.ones(len(hi), bool), np.zeros(len(hi), bool)
            first[1:] = hi[1:] != hi[:-1]
            again[1:] = ~first[1:] & (lo[1:] == lo[:-1])
            if hi[0] == last_hi:  # the group goes on
                first[0], again[0] = False, lo[0] == last_lo
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            m = np.append(lo[starts], 0 if least is None else least)[group]  # group -1 is the last batch's
            yield np.where(first, hi, lo)[~again], m[~again]
            last_hi, last_lo, least = hi[-1], lo[-1], m[-1]

    return _forests(found())


def _stars(links: DataFrame, *parts: Column) -> DataFrame:
    return written(map_arrow(links.repartition("hi", *parts).sortWithinPartitions("hi", "lo"), _small_stars, "hi long, lo long"), "links")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that reaches a smaller one over ``links`` (a, b: long); root is the smallest it reaches.

    Links of a node to itself and links with a null take no part; repeated links count once.
    """
    named = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = _stars(named, F.pmod(F.xxhash64("lo"), F.lit(SALTS)))  # parts of a node's links, as it may have any number of them here
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        low = e.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        last, e = e, _stars(e.join(low, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")))
        dropped(last)
    raise RuntimeError(f"links still change after {most_rounds} rounds")
