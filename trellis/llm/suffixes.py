"""Suffix-array deduplication of byte strings of a fixed length, by deep-shallow sorting.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts anywhere else. Sorting all suffixes would
move the corpus many times over, so suffixes are sorted in groups that hold all that can be equal: each window of
``LENGTH`` bytes has an anchor, the place in it where the hash of ``GRAM`` bytes is least (leftmost), and equal
windows have equal anchors at equal places. A mark is an anchor with the run of windows that have it, about one in
170 bytes.

* Marks whose whole context (all bytes of their windows) occurs again are repeats as they stand, by a count.
* Marks whose gram occurs in no other context have no repeats, by another count.
* The rest, mostly the edges of repeats, are sorted: in a group of one gram the suffixes to the right of the
  anchors and, read backwards, those to the left: multikey quicksort to a shallow depth, then a blind trie for each
  group of suffixes still equal there. The longest common prefixes of neighbours cut both orders into classes for
  each depth, and a window at offset o is a repeat exactly where another suffix shares its left class of depth o
  and its right class of depth ``LENGTH`` - o. Groups over ``MOST`` contexts are split in blocks, and every two
  blocks meet, so a gram that a third of all documents hold is many tasks and still exact.

Only keys, positions and the contexts of the rest are shuffled, and the texts once, by row. Copies of a context
are counted before they are shuffled.

Nulls: a null text is an empty one. A row is known by its id and the hash of its text; repeated rows are copies of
each other, and null ids are allowed. Texts under ``LENGTH`` bytes stay as they are. Other columns are left out. An
empty table gives an empty result. Contexts are compared by 128 bits of hash where they are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text, written

LENGTH, GRAM, MOST, CHUNK, CLASSES = 400, 64, 5_000, 1 << 20, 4
#: Contexts from which whole groups are compared; with a group that is not whole yet, as many as TOGETHER and MOST are held.
TOGETHER = 4_000
_REACH = LENGTH - GRAM + 1  # places for a gram in a window
_PLACE = (1 << 21) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables:
        n = CHUNK + LENGTH
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _tables["up"], _tables["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _tables["byte"] = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["up"], _tables["down"], _tables["byte"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each place."""
    up, down, byte = _powers()
    n = len(data)
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[data] * up[:n], dtype=np.uint64)])
        h = (s[GRAM:] - s[:-GRAM]) * down[: n - GRAM + 1]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(by)
        return h ^ (h >> np.uint64(31))


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) of every mark of a text, in order."""
    out = []
    for base in range(0, len(data) - LENGTH + 1, CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK + LENGTH - 1, len(data) - base), base)
        h = gram_hashes(part)
        n = len(h)
        rows = -(-n // _REACH)
        key = np.full(rows * _REACH, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (h & np.uint64(~_PLACE & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
        block = key.reshape(rows, _REACH)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: n - _REACH + 1], ahead[_REACH - 1 : n]) & np.uint64(_PLACE)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        out.append((at[first] + base, first + base, last + base, h[at[first]]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, each with the hash of its context; neighbours with one context are one row: the first of them, how many, and the last window of all."""
    names = ["k1", "k2", "a", "lo", "hi", "gram", "context", "n", "end"]
    for b in batches:
        held, size = [], 0
        for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
            data = text.as_py().encode()
            a, lo, hi, gram = marks(data)
            if not len(a):
                continue
            context = np.fromiter((xxhash.xxh3_64_intdigest(data[x : z + LENGTH], seed=y - x) for x, y, z in zip(lo.tolist(), a.tolist(), hi.tolist(), strict=True)), np.uint64, len(a))
            new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (gram[1:] != gram[:-1])))
            last = np.append(new[1:], len(a))
            held.append((np.full(len(new), k1), np.full(len(new), k2), a[new], lo[new], hi[new], gram[new].view(np.int64), context[new].view(np.int64), last - new, hi[last - 1]))
            size += len(new)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first ``start`` bytes are known to be equal."""
    n = min(len(a), len(b))
    while start < n:
        x, y = a[start : start + 64], b[start : start + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return start + (m - (d.bit_length() + 7) // 8 if d else m)
        start += 64
    return n


def _blind_trie(s: list[bytes], group: list[int], depth: int) -> list[int]:
    """``group`` in order of the strings, which are equal up to ``depth``: a trie whose nodes keep a depth and branching bytes only.

    A string walks down by its bytes at the nodes' depths, whatever lies between; its common prefix with the leaf
    it meets tells where it belongs.
    """
    byte = lambda i, d: s[i][d] if d < len(s[i]) else -1
    root: list = [group[:1]]  # a leaf: [equal strings]; a node: [depth, {byte: child}]
    for i in group[1:]:
        node, path = root, []
        while len(node) == 2:
            path.append(node)
            node = node[1].get(byte(i, node[0])) or next(iter(node[1].values()))
        other = node[0][0]
        same = common_prefix(s[i], s[other], depth)
        if same == len(s[i]) == len(s[other]):
            node[0].append(i)
            continue
        node = root
        while len(node) == 2 and node[0] < same:
            node = node[1][byte(i, node[0])]
        if len(node) == 2 and node[0] == same:
            node[1][byte(i, same)] = [[i]]
        else:
            below = list(node)
            node[:] = [same, {byte(other, same): below, byte(i, same): [[i]]}]
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        if len(node) == 1:
            out.extend(node[0])
        else:
            open_.extend(node[1][k] for k in sorted(node[1], reverse=True))
    return out


def deep_shallow(s: list[bytes], group: list[int], shallow: int = GRAM + 16, step: int = 8) -> list[int]:
    """``group`` in order of the strings: multikey quicksort by ``step`` bytes to ``shallow``, then blind tries."""
    out: list[int] = []
    open_ = [(group, 0)]
    while open_:
        g, depth = open_.pop()
        if len(g) == 1:
            out.extend(g)
        elif depth >= shallow:
            out.extend(_blind_trie(s, g, depth))
        else:
            keys = [s[i][depth : depth + step] for i in g]
            pivot = keys[len(g) // 2]
            low, same, high = [], [], []
            for i, k in zip(g, keys, strict=True):
                (same if k == pivot else low if k < pivot else high).append(i)
            if high:
                open_.append((high, depth))
            if len(pivot) < step:  # these strings end here
                open_.extend(([i], depth) for i in same)
            else:
                open_.append((same, depth + step))
            if low:
                open_.append((low, depth))
    return out


def _order(s: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All strings in order within their groups, and each one's common prefix with the one before (-1 at a group's start)."""
    order, prefix = [], []
    for g in groups:
        o = deep_shallow(s, g)
        order.extend(o)
        prefix.append(-1)
        prefix.extend(common_prefix(s[x], s[y]) for x, y in zip(o, o[1:], strict=False))
    return np.array(order), np.array(prefix)


def repeats(left: list[bytes], right: list[bytes], groups: list[list[int]]) -> np.ndarray:
    """For each context and offset o: does the window that starts o bytes before the anchor occur in another context of the group?"""
    n = len(left)
    (at_r, lcp_r), (at_l, lcp_l) = _order(right, groups), _order(left, groups)
    found = np.zeros((n, _REACH), bool)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(_REACH):
        class_r[at_r] = np.cumsum(lcp_r < LENGTH - o)
        class_l[at_l] = np.cumsum(lcp_l < o)
        key = class_r * (n + 1) + class_l
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        found[by[1:][same], o] = True
        found[by[:-1][same], o] = True
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (gram, i, j); whole groups are compared together, some thousands of contexts at a time."""

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What Spark hands over at once may be more than is wanted at once."""
        for k in range(0, b.num_rows, TOGETHER):
            yield b.slice(k, TOGETHER)

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([rows.column(c).to_numpy() for c in ("gram", "i", "j")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        groups = [g.tolist() for g in np.split(np.arange(rows.num_rows), edges)]
        found = repeats(rows.column("left").to_pylist(), rows.column("right").to_pylist(), groups)
        found &= rows.column("once").to_numpy()[:, None]
        step = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (who, start), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
        a = rows.column("a").to_numpy()[who]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows.column("k1").to_numpy()[who], rows.column("k2").to_numpy()[who], a - end + 1, a - start)], names=["k1", "k2", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in (x for whole in batches for x in parts(whole)):
        held.append(b)
        size += b.num_rows
        if size >= TOGETHER:
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows.column(c).to_numpy() for c in ("gram", "i", "j")])
            cut = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
            if cut:
                yield from done(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
            size = rows.num_rows - cut
    if size:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted mark, some hundred kilobytes at a time; of the marks only those of one text become objects."""
    names = ["gram", "i", "j", "once", "k1", "k2", "a", "left", "right"]
    for b in batches:
        rows: list[tuple] = []
        size = 0
        wanted, k1s, k2s = b.column("wanted"), b.column("k1"), b.column("k2")
        for at, text in enumerate(b.column("text")):
            own = wanted[at].values
            k1, k2, data = k1s[at].as_py(), k2s[at].as_py(), text.as_py().encode()
            for gram, hot, once, a, lo, hi in zip(*(own.field(c).to_numpy(zero_copy_only=False).tolist() for c in range(6)), strict=True):
                if not hot:
                    rows.append((gram, 0, 0, once, k1, k2, a, data[lo:a][::-1], data[a : hi + LENGTH]))
                    size += hi + LENGTH - lo
                else:
                    for i, (least, most) in enumerate(offsets()):  # windows that start least to most bytes before the anchor share what lies in all of them
                        if a - hi <= most and a - lo >= least:
                            first, past = max(lo, a - most), min(hi, a - least) + LENGTH
                            key = xxhash.xxh3_64_intdigest(data[a - least : a - most + LENGTH]) - (1 << 63)
                            rows.append((gram, 1 + i, key, once, k1, k2, a, data[first:a][::-1], data[a:past]))
                            size += past - first
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays(_columns(rows), names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(rows), names=names)


def offsets() -> list[tuple[int, int]]:
    """The ranges that offsets of windows before their anchor are split in, both ends within."""
    cuts = [_REACH * k // CLASSES for k in range(CLASSES + 1)]
    return [(x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts as a hash of its bytes, with its place."""
    for b in batches:
        out = []
        for i, once, k1, k2, a, left, right in zip(*(b.column(c).to_pylist() for c in ("i", "once", "k1", "k2", "a", "left", "right")), strict=True):
            least, most = offsets()[i - 1]
            data, at = left[::-1] + right, len(left)
            for o in range(max(least, at + LENGTH - len(data)), min(most, at) + 1):
                h = xxhash.xxh3_128_intdigest(data[at - o : at - o + LENGTH])
                out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), once, k1, k2, a - o))
            if len(out) > 50_000:
                yield _window_batch(out)
                out = []
        if out:
            yield _window_batch(out)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["w1", "w2", "once", "k1", "k2", "lo"])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ranges = b.column("ranges")
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)):
                data = text.as_py().encode()
                own = ranges[i].values
                lo, hi = (own.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)) if own is not None else (np.zeros(0, np.int64),) * 2
                by = np.argsort(lo, kind="stable")
                lo, far = lo[by], np.maximum.accumulate(hi[by] + LENGTH) if len(by) else hi
                new = np.flatnonzero(np.append(True, lo[1:] > far[:-1])) if len(lo) else np.zeros(0, np.int64)
                start, stop = lo[new], far[np.append(new[1:], len(lo)) - 1] if len(lo) else lo
                edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(data)]
                rest = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(data), int((stop - start).sum()), len(start), sha256(rest).hexdigest(), *([rest] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    return run


def _hot_repeats(cut: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi) of the contexts ``cut`` by class of offsets: compared where a group is small, counted window by window where it isn't."""
    cut = written(cut, "classes")
    sizes = cut.groupBy("gram", "i", "j").agg(F.count("*").alias("size"), F.max("once").alias("any_once")).where("size > 1 and any_once").select("gram", "i", "j", "size")
    sized = cut.join(sizes, ["gram", "i", "j"])
    small = sized.where(F.col("size") <= MOST).drop("size")
    compared = map_arrow(small.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j"), _compared, "k1 long, k2 long, lo long, hi long")
    windows = map_arrow(sized.where(F.col("size") > MOST).select("i", "once", "k1", "k2", "a", "left", "right"), _windows, "w1 long, w2 long, once boolean, k1 long, k2 long, lo long")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return compared.unionByName(windows.where("once").join(again, ["w1", "w2"]).select("k1", "k2", "lo", F.col("lo").alias("hi")))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``; with_text: also ``kept``, the bytes that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), "doc_id", "text"
    )
    found = written(map_arrow(rows.select("k1", "k2", "text"), _marked, "k1 long, k2 long, a long, lo long, hi long, gram long, context long, n long, end long"), "marks")
    contexts = written(
        found.groupBy("gram", "context").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "a", "lo", "hi"))),
        "contexts",
    )
    mixed = contexts.groupBy("gram").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("single")).where("contexts > 1 and single > 0").drop("single")

    def cut(hot: bool) -> DataFrame:
        some = mixed.where((F.col("contexts") > MOST) == F.lit(hot))
        wanted = (
            contexts.join(some, "gram")
            .withColumns({"once": F.col("n") == 1, "hot": F.lit(hot)})
            .groupBy("k1", "k2")
            .agg(F.collect_list(F.struct("gram", "hot", "once", "a", "lo", "hi")).alias("wanted"))  # of one text
        )
        return map_arrow(
            rows.join(wanted, ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "wanted"),  # the columns of the last join, so that one shuffle of the texts serves both
            _contexts,
            "gram long, i long, j long, once boolean, k1 long, k2 long, a long, left binary, right binary",
        )

    sorted_out = map_arrow(cut(False).repartition("gram").sortWithinPartitions("gram"), _compared, "k1 long, k2 long, lo long, hi long")
    if not mixed.where(F.col("contexts") > MOST).isEmpty():
        sorted_out = sorted_out.unionByName(_hot_repeats(cut(True)))
    counted = found.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"]).select("k1", "k2", "lo", F.col("end").alias("hi"))
    ranges = sorted_out.unionByName(counted).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # of one text
    kept = rows.join(ranges, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "ranges")
    return map_arrow(kept, _kept(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
