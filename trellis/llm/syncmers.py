"""Document fingerprints of closed syncmers.

A text is cut at white space, and words at every eight code points; tokens are hashed. Of all k-mers of ``K`` tokens
those are kept whose smallest inner s-mer (``S`` tokens) lies at an edge: closed syncmers, about two in K - S + 1 (two
in five here), whose choice depends on nothing outside the k-mer, so that an equal passage has equal anchors wherever
it stands. The fingerprint is the sketch of the 64 smallest distinct 32-bit hashes of the kept k-mers; the likeness of
two is the estimate of the Jaccard similarity of their sets of anchors (exact up to 64). A text of under K tokens, or
where no k-mer is kept, has the hash of the whole sequence as its one anchor. ``anchors`` has the positions, and
``passages`` matches them: anchors that two texts share at one distance are a passage that they share.

All of it is DataFrame expressions. Neighbours in the order of ids are found in ranges of ids: each range also gets
the first row of the next one, so one window for a range is enough and no task holds the table.

Nulls: a null text is an empty one; null ids come last in descending order. Repeated ids are ordered by the hash of
their text. A single row is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SKETCH = 64
#: Tokens of a k-mer and of an s-mer in it.
K, S = 6, 2
#: Ranges of ids for each shuffle partition.
RANGES = 8


def _tokens(text: str) -> str:
    return f"transform(regexp_extract_all({text}, r'\\S{{1,8}}', 0), t -> xxhash64(t))"


def _closed(anchor: str) -> str:
    """SQL of an array over the places of k-mers in ``_s``, the hashes of s-mers: ``anchor`` with the k-mer's hash for ``$x``, null where it isn't kept."""
    inner = ", ".join(f"get(_s, i + {j})" for j in range(1, K - S))
    whole = ", ".join(f"get(_s, i + {j})" for j in range(0, K, S))
    return f"""transform(if(size(_s) <= K_S, cast(array() as array<int>), sequence(0, size(_s) - K_S - 1)), i ->
        if(least(get(_s, i), get(_s, i + K_S)) <= least({inner}), {anchor.replace("$x", f"xxhash64({whole})")}, null))""".replace("K_S", str(K - S))


def _s_mers(text: str) -> tuple[str, str]:
    return _tokens(text), f"transform(if(size(_h) < {S}, cast(array() as array<int>), sequence(0, size(_h) - {S})), i -> xxhash64({', '.join(f'get(_h, i + {j})' for j in range(S))}))"


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted sketch of the column ``text``."""
    h, s = _s_mers(text)
    return (
        df.withColumn("_h", F.expr(h))
        .withColumn("_s", F.expr(s))
        .withColumn("_k", F.array_compact(F.expr(_closed("$x"))))
        .withColumn(name, F.expr(f"slice(array_sort(array_distinct(transform(if(size(_k) = 0, array(xxhash64(_h)), _k), x -> shiftrightunsigned(x, 32)))), 1, {SKETCH})"))
        .drop("_h", "_s", "_k")
    )


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, anchor): every closed syncmer with the number of its first token, for matching by position."""
    h, s = _s_mers("_t")
    found = docs.select("doc_id", whole_text().alias("_t")).withColumn("_h", F.expr(h)).withColumn("_s", F.expr(s))
    kept = F.array_compact(F.expr(_closed("named_struct('position', i, 'anchor', $x)")))
    return found.withColumn("_k", kept).select("doc_id", F.explode("_k").alias("_a")).select("doc_id", "_a.position", "_a.anchor")


def passages(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, other, shift, first, last, anchors): passages shared with ``other``, by matching positions of anchors.

    Each anchor is held against its first place (the smallest doc_id, then position) alone, so that an anchor of many
    texts makes as many rows as it has places, not pairs; ``least`` of them at one shift are a passage, from token
    ``first`` to ``last``. Rows without an id take no part; rows of one id are one text.
    """
    every = anchors(docs.where("doc_id is not null"))
    places = every.groupBy("anchor").agg(F.min(F.struct("doc_id", "position")).alias("_f"), F.count("*").alias("_n")).where("_n > 1").select("anchor", F.col("_f.doc_id").alias("other"), F.col("_f.position").alias("_at"))
    shared = every.join(places, "anchor").where("doc_id <> other").withColumn("shift", F.col("position") - F.col("_at"))
    found = shared.groupBy("doc_id", "other", "shift").agg(F.min("position").alias("first"), (F.max("position") + K - 1).alias("last"), F.count("*").alias("anchors"))
    return found.where(F.col("anchors") >= least)


def likeness(a: str, b: str) -> Column:
    """The share of the smallest hashes of both sketches that lie in both."""
    both = f"slice(array_sort(array_union({a}, {b})), 1, {SKETCH})"
    return F.expr(f"cast(size(array_intersect(array_intersect({a}, {b}), {both})) as double) / size({both})")


def as_text(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def _ranges(docs: DataFrame) -> tuple[list[int], list[int | None], list[int]]:
    """Bounds of ranges of ids, RANGES for each shuffle partition, so that these get about as many rows each; each range's largest id; the range that its first row goes to as well."""
    n = RANGES * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(found))
    most = {r.b: r.m for r in docs.select(_range_of(bounds).alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("m")).collect()}  # at most n rows
    there = sorted(most)
    goes = {b: there[i + 1] if i + 1 < len(there) else there[0] for i, b in enumerate(there)}
    return bounds, [most.get(b) for b in range(len(bounds) + 1)], [goes.get(b, -1) for b in range(len(bounds) + 1)]


def _range_of(bounds: list[int]) -> Column:
    """The number of bounds that are not above doc_id, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    b = f"array({', '.join(f'{x}L' for x in bounds)})"
    mid = "cast((a.lo + a.hi) / 2 as int)"
    return F.expr(f"""aggregate(sequence(0, {len(bounds).bit_length()}), named_struct('lo', 0, 'hi', {len(bounds)}), (a, i) ->
        if(a.lo >= a.hi, a, if(coalesce(get({b}, {mid}) <= doc_id, false), named_struct('lo', {mid} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {mid}))), a -> a.lo)""")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """Adds ``next_c`` for each column c of ``carried``: that of the next row by descending doc_id, of the first row for the last."""
    bounds, most, goes = _ranges(docs)
    most_of = f"array({', '.join('cast(null as bigint)' if m is None else f'{m}L' for m in most)})"
    goes_to = f"array({', '.join(map(str, goes))})"
    dealt = (
        docs.withColumn("_trellis_own", _range_of(bounds))
        .withColumn("_trellis_to", F.expr(f"if(doc_id <=> get({most_of}, _trellis_own), array(named_struct('at', _trellis_own, 'extra', 0), named_struct('at', get({goes_to}, _trellis_own), 'extra', 1)), array(named_struct('at', _trellis_own, 'extra', 0)))"))
        .withColumn("_trellis_at", F.explode("_trellis_to"))
        .withColumns({"_trellis_range": F.col("_trellis_at.at"), "_trellis_extra": F.col("_trellis_at.extra"), "_trellis_tie": F.xxhash64("text")})
    )
    order = Window.partitionBy("_trellis_range").orderBy("_trellis_extra", F.desc_nulls_last("doc_id"), "_trellis_tie")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_trellis_extra = 0").drop("_trellis_own", "_trellis_to", "_trellis_at", "_trellis_range", "_trellis_extra", "_trellis_tie")


def report(docs: DataFrame) -> DataFrame:
    """The digest: fingerprints of each text and of its edited text, and how like they and the next document's are."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    df = with_next(with_sketch(df.withColumn("n_chars", F.char_length("text").cast("long")), "text", "sketch"), "text", "sketch")
    df = df.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))"))
    df = with_sketch(df.drop("text", "next_text"), "edited", "edited_sketch")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
