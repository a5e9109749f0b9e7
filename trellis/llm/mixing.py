"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target rows times its weight over its rows. For every document a number from
the hash of its id and a seed inverts the Poisson distribution of that mean; the document is repeated so often, and
all copies are dealt over the cluster by a second hash, in whose order they lie in their partition. The mean may be
any size: one over ``PIECE`` is a sum of independent parts. Only counts for each source are gathered; their table is
broadcast if it is small, which is checked, and else joined by a shuffle whose hot keys Spark splits.

Nulls: a null source is a source of its own; a null id is drawn by the hash of its text. Repeated rows are drawn
alike. Weights of sources that are missing from the table count for nothing, sources without a weight get none
(no copies). Columns of the input whose names are those of the result's are replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Largest mean that one number inverts; largest table of sources to broadcast, in rows and in characters.
PIECE, ROWS, CHARS = 64.0, 20_000, 4_000_000
_NONE = "\x00none"


def _unit(key: str) -> str:
    """SQL of a number in [0, 1) from 52 bits of the hash of ``key``."""
    return f"(cast(conv(substring(md5(cast({key} as binary)), 1, 13), 16, 10) as double) / 4503599627370496D)"


def rates(docs: DataFrame, weights: dict[str, float] | None, target: float | None) -> DataFrame:
    """(_source, _rate): the mean number of copies of a document of each source; equal weights unless given."""
    many = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("_source")).agg(F.count("*").alias("_n"))
    many = written(many, "sources")
    if weights is None:
        weighed = many.withColumn("_weight", F.lit(1.0))
    else:
        given = many.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, _weight double")
        weighed = many.join(given, "_source", "left").fillna(0.0, ["_weight"])
    whole = weighed.agg(F.sum("_weight").alias("w"), F.sum("_n").alias("n"), F.count("*").alias("rows"), F.sum(F.length("_source")).alias("chars")).first()
    if not whole.w:
        return weighed.select("_source", F.lit(0.0).alias("_rate"))
    out = weighed.select("_source", ((F.lit(float(target if target is not None else whole.n)) * (F.col("_weight") / F.lit(float(whole.w)))) / F.col("_n")).alias("_rate"))
    return F.broadcast(out) if whole.rows <= ROWS and whole.chars <= CHARS else out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, seed: int = 7, numbered: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its Poisson number, in the order of a global shuffle.

    ``numbered`` adds n_copies, copy_no (from 1) and shuffle_key.
    """
    t = "_trellis_"
    df = docs.withColumn(t + "source", F.coalesce(F.col("source").cast("string"), F.lit(_NONE)))
    df = df.withColumn(t + "id", F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    df = df.join(rates(docs, weights, target).select(F.col("_source").alias(t + "source"), F.col("_rate").alias(t + "rate")), t + "source")
    draw = f"""aggregate(sequence(0, cast(ceil({t}rate / {PIECE}D) as int) - 1), 0, (t, i) -> t + aggregate(
        sequence(1, cast(ceil({t}part + 14 * sqrt({t}part) + 40) as int)),
        named_struct('u', {_unit(f"concat({seed}, ':', if(i = 0, '', concat(i, ':')), {t}id)")}, 'p', exp(-{t}part), 'f', exp(-{t}part), 'n', 0),
        (a, k) -> named_struct('u', a.u, 'p', a.p * {t}part / k, 'f', a.f + a.p * {t}part / k, 'n', if(a.f < a.u, k, a.n)),
        a -> a.n))"""
    df = df.withColumn(t + "part", F.expr(f"{t}rate / greatest(ceil({t}rate / {PIECE}D), 1)")).withColumn(t + "n_copies", F.expr(f"if({t}rate > 0, {draw}, 0)"))
    out = df.where(F.col(t + "n_copies") > 0).withColumn(t + "copy_no", F.explode(F.expr(f"sequence(1, {t}n_copies)")))
    out = out.withColumn(t + "shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), t + "id", F.lit(":"), F.col(t + "copy_no").cast("string"))))
    out = out.repartition(t + "shuffle_key").sortWithinPartitions(t + "shuffle_key")
    fresh = ["n_copies", "copy_no", "shuffle_key"] if numbered else []
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in fresh), *(F.col(t + c).alias(c) for c in fresh))


ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, (total * (1.0::DOUBLE / sources::DOUBLE)) / n AS r
          FROM counts, (SELECT sum(n)::DOUBLE AS total, count(*) AS sources FROM counts)),
cdf(source, r, k, p, f) AS (
  SELECT source, r, 0, exp(-r), exp(-r) FROM rated
  UNION ALL SELECT source, r, k + 1, p * r / (k + 1), f + p * r / (k + 1) FROM cdf WHERE k < ceil(r + 14 * sqrt(r) + 40)),
drawn AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
          ('0x' || substr(md5('7:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents d),
copies AS (SELECT w.doc_id, w.source, w.lang, w.n_chars, w.text, CAST(count(*) FILTER (WHERE c.f < w.u) AS INTEGER) AS n_copies
           FROM drawn w JOIN cdf c ON c.source = w.source GROUP BY ALL)
SELECT doc_id, source, lang, n_chars, text, n_copies, CAST(c AS INTEGER) AS copy_no, md5('7:' || doc_id || ':' || c) AS shuffle_key
FROM copies, unnest(range(1, n_copies + 1)) AS t(c)
"""
