"""Benchmark decontamination by winnowing: which words of a document are also in a benchmark item.

A window is ten consecutive words. Of every five neighbouring grams of six words (which make up one window) the ones
with the least hash are fingerprints, so a window that a document and an item share has a fingerprint in both, at the
same place in the window: every shared span of ten words or more is found. Fingerprints of the documents are joined
with those of the items; each hit carries the up to fourteen words around it, and is extended to the five windows that
hold the gram. A window counts if an item has the same words, by comparison of the words themselves; hashes only
propose. Items of fewer than ten words are one window each; for every such length that occurs (nine at most)
documents propose all their grams of that length.

One pass reads the documents: a row for each document and its hits are written, nothing else of the texts is kept.
The items' fingerprints are broadcast if they are at most ``FEW``, and joined by a shuffle beyond that, where each
fingerprint is one row on the items' side and Spark can split the hot ones of the documents' side. A document is known
by 128 bits of hash of its id and text, so that copies under many ids don't meet in one group. What is gathered for a
document is at most its own windows and the items that hold them.

Nulls: a null text has no words; an item without an id is listed as ''. Repeated documents give repeated rows, equal ids
of items count once. Other columns are not looked at. Empty tables: no documents give an empty result, no items leave
all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .words import words

#: What is between words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window and of a gram; a window holds NEXT grams.
WINDOW, GRAM = 10, 6
NEXT = WINDOW - GRAM + 1
#: Fingerprints of items (of eight bytes) that are broadcast.
FEW = 1_000_000
_KEY = ["_k1", "_k2"]


def _grams(k: int) -> Column:
    """The hash of each gram of ``k`` words, from the hashes of the words in ``c``."""
    return F.transform(F.slice("c", F.lit(1), F.greatest(F.size("c") - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(k), x, *(F.get("c", i + j) for j in range(1, k))))


def fingerprinted(df: DataFrame) -> DataFrame:
    """Adds ``c`` (hash of each of the ``words``), ``g`` (of each gram) and ``least`` (the least of each window)."""
    df = df.withColumn("c", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("g", _grams(GRAM))
    inner = F.slice("g", F.lit(1), F.greatest(F.size("g") - (NEXT - 1), F.lit(0)))
    return df.withColumn("least", F.transform(inner, lambda x, i: F.least(x, *(F.get("g", i + j) for j in range(1, NEXT)))))


def _chosen() -> Column:
    """(h, at, size, around) of the grams that are the least of a window that holds them; ``around`` has the words of these windows."""
    of_windows = lambda i: F.greatest(*(F.get("least", i - j) for j in range(NEXT)))
    around = lambda i: F.array_join(F.slice("words", F.greatest(i - (NEXT - 1), F.lit(0)) + 1, F.least(i, F.lit(NEXT - 1)) + WINDOW), " ")
    made = F.transform("g", lambda h, i: F.when(h == of_windows(i), F.struct(h.alias("h"), i.alias("at"), F.lit(WINDOW).alias("size"), around(i).alias("around"))))
    return F.filter(made, lambda x: x.isNotNull())


def _all_of(k: int) -> Column:
    """(h, at, size, around) of every gram of ``k`` words."""
    return F.transform(_grams(k), lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.lit(k).alias("size"), F.array_join(F.slice("words", i + 1, F.lit(k)), " ").alias("around")))


def items_words(benchmark: DataFrame) -> DataFrame:
    """(item, words) of the items that have words."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(whole_text(), BETWEEN).alias("words")).where(F.size("words") > 0)


def items_fingerprints(items: DataFrame, short: list[int]) -> DataFrame:
    """(h): the distinct fingerprints of the items."""
    df = fingerprinted(items)
    own = F.when(F.size("words") >= WINDOW, F.transform(_chosen(), lambda x: x["h"]))
    for k in short:
        own = own.when(F.size("words") == k, _grams(k))
    return df.select(F.explode(own).alias("h")).distinct()


def items_windows(items: DataFrame) -> DataFrame:
    """(window, items): the words of each window, and the items that have it."""
    starts = F.expr(f"transform(slice(words, 1, greatest(size(words) - {WINDOW - 1}, 1)), (w, i) -> array_join(slice(words, i + 1, {WINDOW}), ' '))")
    return items.select("item", F.explode(starts).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def proposals(docs: DataFrame, prints: DataFrame, short: list[int]) -> DataFrame:
    """(key, doc_id, n_words, at, size, around): each document's hits, and one row for the document itself, of which ``at`` is -1."""
    df = docs.select("doc_id", F.xxhash64("doc_id", "text").alias(_KEY[0]), F.xxhash64(F.lit(13), "text", "doc_id").alias(_KEY[1]), words(whole_text(), BETWEEN).alias("words"))
    df = fingerprinted(df)
    head = F.array(F.struct(F.col(_KEY[0]).alias("h"), F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit("").alias("around")))
    rows = df.select(*_KEY, "doc_id", F.size("words").alias("n_words"), F.explode(F.concat(head, _chosen(), *(_all_of(k) for k in short))).alias("x"))
    rows = rows.select(*_KEY, "doc_id", F.col("x.at").alias("at"), F.when(F.col("x.at") < 0, F.col("n_words").cast("long")).alias("n_words"), F.col("x.size").alias("size"), F.col("x.around").alias("around"), F.col("x.h").alias("h"))
    return rows.join(prints.withColumn("hit", F.lit(True)), "h", "left").where("hit or at < 0").drop("h", "hit")


def extended(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, s, e, items): the windows around each hit that some item has, as places of words in the document."""
    near = hits.withColumn("w", F.split("around", " ")).withColumn("before", F.least("at", F.lit(NEXT - 1)))
    each = F.expr(f"""if(size < {WINDOW}, array(named_struct('s', at, 'window', around)),
        filter(transform(slice(w, 1, before + 1), (x, i) -> named_struct('s', at - before + i, 'window', if(i + {WINDOW} <= size(w), array_join(slice(w, i + 1, {WINDOW}), ' '), null))),
            x -> x.window is not null))""")
    rows = near.select(*_KEY, "size", F.explode(each).alias("x")).select(*_KEY, F.col("x.s").alias("s"), (F.col("x.s") + F.col("size")).alias("e"), F.col("x.window").alias("window"))
    return rows.join(windows, "window").select(*_KEY, "s", "e", "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for each row of ``docs``.

    ``items`` are the sorted ids of the items with a window in the document, ``spans`` the runs of hit words (s, e), e
    exclusive, both empty for a clean document.
    """
    items = written(items_words(benchmark), "items")
    short = sorted(r.n for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())  # nine numbers at most
    prints = written(items_fingerprints(items, short), "fingerprints")
    if prints.count() <= FEW:
        prints = F.broadcast(prints)
    windows = written(items_windows(items), "windows")
    met = written(proposals(docs, prints, short), "hits")
    found = extended(met.where("at >= 0"), windows).groupBy(*_KEY)
    found = found.agg(F.collect_set(F.struct("s", "e")).alias("each"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.withColumn("hit", F.expr("sort_array(array_distinct(flatten(transform(each, x -> sequence(x.s, x.e - 1)))))"))
    starts, ends = F.expr("filter(hit, (x, i) -> i = 0 or get(hit, i - 1) < x - 1)"), F.expr("transform(filter(hit, (x, i) -> coalesce(get(hit, i + 1) > x + 1, true)), x -> x + 1)")
    found = found.select(*_KEY, "items", F.size("hit").cast("long").alias("n_hit"), F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("spans"))
    df = met.where("at < 0").select(*_KEY, "doc_id", "n_words").join(found, _KEY, "left")
    none = {"items": "cast(array() as array<string>)", "spans": "cast(array() as array<struct<s:int,e:int>>)", "n_hit": "cast(0 as bigint)"}
    df = df.withColumns({c: F.coalesce(c, F.expr(x)) for c, x in none.items()})
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", "spans",
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("items", "spans")


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM ip),
sizes AS (SELECT DISTINCT m FROM iwin),
dp AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, sizes WHERE len(w) >= m),
dwin AS (SELECT r, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM dp),
met AS (SELECT d.r, d.m, d.s, i.item FROM dwin d JOIN iwin i ON i.m = d.m AND i.win = d.win),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS place FROM met) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
