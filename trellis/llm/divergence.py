"""How far the sources of a language differ in their words, and which words set a source apart.

Every document's words are sorted in its row and go out one by one, each with the word before it, so that the first of
equal ones is known; a map-side sum leaves one row for each language, source and term. Terms in enough documents of
the language are kept as wide vectors: one row for each term, an array with a place for each source of the language.
From a vector, higher-order functions give what the term adds to each pair of sources, one source at a time, and a
map-side sum over terms leaves one row for each pair. Top terms are cut to ten in each task before they are shuffled.

Probabilities are in parts of 10^9 with one more, smoothed by two: p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)); a
difference is floor((p - q)^2 / (p + q)). Counts are multiplied as decimals of 38 digits, which hold counts up to
10^27; (p - q)^2 is at most 10^18 and fits a long, as does a sum of differences (2 * 10^9 and the number of terms).

A vector has as many places as its language has sources, and a pair of sources is a row of the result, so what one
row or task holds is bounded by the sources of a language, not by documents or terms.

Nulls: null text, lang and source are ''. A group without terms takes part with counts of zero; without kept terms
all differences are 0 (and there are no top terms). Each row counts as a document, repeated rows too. Ties are ranked
by the item's bytes. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .words import UPPER

#: What is between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must be in; ranks of terms in the result.
LEAST_DOCS, TOP = 10, 10


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term.

    A document's sorted words go out as rows, each with the word before it: where the two differ, a document begins to have a term.
    """
    sorted_words = F.sort_array(F.split(F.translate(whole_text(), UPPER, UPPER.lower()), BETWEEN, -1))
    df = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), sorted_words.alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("term"), F.concat(F.array(F.lit("")), F.col("w")).alias("before"))  # one more before than there are words
    rows = df.select("lang", "source", F.explode(pairs).alias("r")).select("lang", "source", "r.term", "r.before").where("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, by_source: map of source to occurrences) of the terms in enough documents of the language."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return by_term.where(F.col("docs") >= least_docs).drop("docs")


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, v, total, sources: array of (source, total) in order of their bytes): one row for each language."""
    groups = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source")).distinct()
    sums = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    many = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_lang = (
        groups.join(sums, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    )
    return of_lang.join(many, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["total"]).alias("total"), "sources")


def _part(count: str, total: str) -> str:
    """SQL of the smoothed probability in parts of 10^9, and one."""
    return f"((cast(1000000000 as decimal(10,0)) * (cast({count} as decimal(20,0)) + 2)) div cast({total} + 2 * v as decimal(31,0)) + 1)"


def vectors(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, term, q, sources, by_source, p): the language's part, and an array of parts with a place for each source."""
    wide = kept.join(langs, "lang")  # a row for each language: broadcast if Spark finds it small
    p = F.expr(f"transform(sources, s -> {_part('coalesce(try_element_at(by_source, s.source), 0)', 's.total')})")
    return wide.select("lang", "term", F.expr(_part("n", "total")).alias("q"), "sources", "by_source", p.alias("p"))


def pair_sums(wide: DataFrame) -> DataFrame:
    """(lang, i, j, value) for places i < j of a vector: the differences summed over all terms."""
    one = wide.select("lang", "p", F.posexplode("p").alias("i", "a"))
    each = F.expr("transform(slice(p, i + 2, size(p)), b -> ((a - b) * (a - b)) div (a + b))")
    two = one.select("lang", "i", F.posexplode(each).alias("ahead", "f"))
    return two.groupBy("lang", "i", "ahead").agg(F.sum("f").alias("value")).select("lang", "i", (F.col("i") + F.col("ahead") + 1).alias("j"), "value")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def pair_part(langs: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language."""
    one = langs.select("lang", "sources", F.posexplode("sources").alias("x", "s"))
    both = one.select("lang", "x", F.col("s.source").alias("source"), F.posexplode("sources").alias("y", "o")).where("x <> y")
    both = both.select("lang", "source", F.col("o.source").alias("item"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return _ranked(both.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value")))


def term_part(wide: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms a source has more of than its language."""
    own = F.expr("filter(zip_with(sources, p, (s, x) -> named_struct('source', s.source, 'p', x)), x -> x.p > q and try_element_at(by_source, x.source) > 0)")
    rows = wide.select("lang", "term", "q", F.explode(own).alias("x"))
    rows = rows.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.expr("((x.p - q) * (x.p - q)) div (x.p + q)").alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)  # Spark keeps the first ranks of each task before it shuffles them


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for the other sources, ``term`` rows for the terms of most difference."""
    spark = docs.sparkSession
    kept = written(kept_terms(term_counts(docs), least_docs), "terms")
    langs = written(languages(docs, kept), "languages")
    # a term costs as much as its language has pairs of sources, however few bytes it has: dealt out by number, not by size
    wide = vectors(kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "term"), langs)
    pairs = pair_part(langs, pair_sums(wide)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(term_part(wide, top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
vocab AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce((SELECT sum(c.n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
           FROM (SELECT DISTINCT lang, source FROM d) g),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
      FROM groups g JOIN kept k ON k.lang = g.lang JOIN vocab v ON v.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
