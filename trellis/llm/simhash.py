"""SimHash near-duplicates: segment popcounts as a metric embedding, joined on a grid.

A fingerprint's eight bytes are mapped to their bit counts. Two fingerprints that differ in d bits have counts that
differ by d at most in Manhattan distance, so a range join of the counts within d misses no pair; its grid cells
are the count vectors themselves. Every distinct fingerprint is sent to its own cell and to those within the
distance in one half of the directions, and there, in order of the cells, compared exactly in blocks. A cell
hands on a spanning forest of its links, not all pairs, and components follow from these. Cells that are home to over
``HOT`` fingerprints (those near four bits a byte grow with the table) are divided by a second grid, the counts of
eight other segments (every eighth bit), which two fingerprints at that distance share in the same way.

Only distinct fingerprints are joined: copies of a text, however many, are one row there.

Nulls: a null text is an empty one and has fingerprint zero; a null id counts for no component's smallest id (a
component without any id has null). Repeated rows keep their rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, whole_text, written
from .components import components, forest


#: Distinct fingerprints at home in a cell from which it is divided.
HOT = 4_096


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bits set in over half of the XXH64 hashes of its word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z alone, split() cuts at 20 and 09-0D
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        hashes = [h(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-words_each].tolist()]
        hashes = [h(line[s:e], seed) for s, e in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], names=[*(n for n in b.schema.names if n != "text"), "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint's 64 bits as a long."""
    named = docs.select(*(docs[c] for c in keep), whole_text().alias("text"))
    schema = StructType([*(named.schema[c] for c in keep), StructField("fp", LongType())])
    return map_arrow(named, _fingerprinted, schema)


def _directions(segments: int, within: int, half: bool = True) -> list[int]:
    """Steps between cells (four bits a coordinate) of at most ``within`` in Manhattan distance: zero, and one of each two opposite ones or all."""
    found = [0]
    for k in range(1, within + 1):
        for where in combinations(range(segments), k):
            for by in product(range(-within, within + 1), repeat=k):
                if 0 not in by and sum(map(abs, by)) <= within and (by[-1] > 0 or not half):
                    found.append(sum(d << (4 * i) for i, d in zip(where, by, strict=True)))
    return found


def _linked(cell: np.ndarray, role: np.ndarray, fp: np.ndarray, within: int, among: bool = True, block: int = 1 << 19) -> list[pa.RecordBatch]:
    """Links of rows in order of (cell, role): each of role 0 with all rows behind it in its cell or, unless ``among``, with those of role 1."""
    if not len(cell):
        return []
    end = np.searchsorted(cell, cell, side="right")
    homes = np.flatnonzero(role == 0)
    first = homes + 1 if among else np.searchsorted(cell, cell[homes], side="left") + np.add.reduceat(role == 0, np.unique(cell, return_index=True)[1])[np.unique(cell, return_inverse=True)[1][homes]]
    many = end[homes] - first
    homes, first, many = homes[many > 0], first[many > 0], many[many > 0]
    out_a, out_b, held = [], [], 0
    reach = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < len(homes):
        n = max(k + 1, int(np.searchsorted(reach, reach[k] + block, side="right")) - 1)
        i = np.repeat(homes[k:n], many[k:n])
        j = np.repeat(first[k:n], many[k:n]) + np.arange(len(i)) - np.repeat(reach[k:n] - reach[k], many[k:n])
        near = np.flatnonzero((np.bitwise_count(fp[i] ^ fp[j]) <= within) & (fp[i] != fp[j]))
        out_a.append(fp[i[near]])
        out_b.append(fp[j[near]])
        held += len(near)
        if held > block:
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [a], [b], len(a)
        k = n
    if not held:
        return []
    a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
    return [pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])]


def _cells_linked(within: int, among: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            cell, role, fp = (b.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "role", "fp"))
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1], side="left"))  # the last cell may go on in the next batch
            if cut or (held and held[-1][0][-1] != cell[0]):
                done = [*held, (cell[:cut], role[:cut], fp[:cut])]
                yield from _linked(*(np.concatenate(x) for x in zip(*done, strict=True)), within, among) if done else ()
                held = []
            held.append((cell[cut:], role[cut:], fp[cut:]))
        if held:
            yield from _linked(*(np.concatenate(x) for x in zip(*held, strict=True)), within, among)

    return lambda batches: run(_unsigned(batches))


def _unsigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("role"), pa.array(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))], names=["cell", "role", "fp"])


def _counts(masks: list[int], within: int) -> str:
    """SQL of the vector of the bit counts of ``fp`` under the masks, four bits a coordinate."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    one = lambda m: "cast('-9223372036854775808' as bigint)" if m == -(1 << 63) else f"{m}L"
    return " + ".join(f"((bit_count(fp & {one(m)}) + {within}L) << {4 * i})" for i, m in enumerate(signed))


#: The bytes of a fingerprint, and the bits that are equal places of all bytes.
BYTES = [0xFF << 8 * i for i in range(8)]
PLACES = [sum(1 << 8 * j + i for j in range(8)) for i in range(8)]


def links(distinct: DataFrame, within: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``distinct`` (fp) that chains of at most ``within`` bits connect."""
    steps = lambda half: F.explode(F.array(*(F.lit(d).cast("long") for d in _directions(8, within, half))))
    homes = distinct.select("fp", F.expr(_counts(BYTES, within)).alias("own"))
    spread = homes.select("fp", "own", steps(True).alias("step")).select((F.col("own") + F.col("step")).alias("cell"), (F.col("step") != 0).cast("int").alias("role"), "fp")
    hot = homes.groupBy(F.col("own").alias("cell")).count().where(F.col("count") > HOT).select("cell")
    compared = lambda rows: map_arrow(rows.select("cell", "role", "fp").repartition("cell").sortWithinPartitions("cell", "role"), _cells_linked(within), "a long, b long")
    if hot.isEmpty():
        return compared(spread)
    # In a hot cell each that is at home goes to all cells of the second grid near it, and each row waits in its own.
    inner = spread.join(hot, "cell", "left_semi").withColumn("own", F.expr(_counts(PLACES, within)))
    wait = inner.select(F.xxhash64("cell", "own").alias("cell"), F.lit(1).alias("role"), "fp")
    go = inner.where("role = 0").select("cell", "fp", "own", steps(False).alias("step")).select(F.xxhash64("cell", F.col("own") + F.col("step")).alias("cell"), F.lit(0).alias("role"), "fp")
    return compared(spread.join(hot, "cell", "left_anti")).unionByName(map_arrow(wait.unionByName(go).repartition("cell").sortWithinPartitions("cell", "role"), _cells_linked(within, False), "a long, b long"))


def near_roots(docs: DataFrame, within: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_key), one for each row of ``docs``, and (node, root): the least fingerprint of a group for each other one."""
    rows = written(fingerprints(docs.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_key")), "doc_id", "text_key"), "fingerprints")
    return rows, components(links(rows.select("fp").distinct(), within))


def near_groups(docs: DataFrame, within: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_key), one for each row of ``docs``, and groups (fp, component_id)."""
    rows, found = near_roots(docs, within)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, written(placed.join(ids, "root").select("fp", "component_id", "root"), "groups")


def near_duplicates(docs: DataFrame, within: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    rows, groups = near_groups(docs, within)
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, within: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id (null ids last), then hash of the text; of repeated rows one."""
    rows, groups = near_groups(docs, within)
    return first_of_groups(docs, rows.join(groups.select("fp", "root"), "fp"))


def first_of_groups(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each root of ``placed`` (doc_id, text_key, root).

    Texts are moved once: rows meet what stays, and repeated rows each other, by the same columns.
    """
    keys = ["_trellis_text", "_trellis_id", "_trellis_none"]
    named = lambda d, text_key: d.withColumns(dict(zip(keys, (text_key, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()), strict=True)))
    first = (
        named(placed, F.col("text_key"))
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", *keys)).alias("first"))
        .select(*(F.col(f"first.{k}") for k in keys))
    )
    return named(docs, F.xxhash64(whole_text())).join(first, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))
