"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a general and of a learnt lexicon (plain, and after undoing common disguises), their
distinct counts, nearness of second-person words to lexicon words, shares of capitals and punctuation, marks that
shout, characters repeated for stress, digits and signs inside words, words repeated, length. The learnt lexicon
has the words, and the beginnings of words, that most favour label 1. It and the trees are fitted on four fifths of
the sample, by a hash of the id, and calibrated on the rest, which neither has seen. The sample is at most ``SAMPLE`` labelled documents, never of the held-out fifth; labels,
language, source and id are no inputs of a score. Every text is scored whole.

Nulls: a null text is an empty one and is scored as such; a null id counts as held out. Without any labels every
score is one half or less, the same for all. Repeated rows keep their rows. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import is_held_out, labelled_sample, map_arrow, whole_text, written

#: Bound of the labelled sample, in documents; and of the learnt lexicon, in words and in stems.
SAMPLE, LEARNT = 12_000, 96
#: Seed of the part that is set aside for calibration.
ASIDE = 5
#: Letters of a stem: words that are inflected or compounded share their beginning.
STEM = 4
#: A general lexicon of insults.
GENERAL = frozenset(
    "idiot idiots moron morons stupid dumb fool scum trash garbage worthless pathetic disgusting loser losers clown ugly hate kill shut "
    "dummkopf trottel abschaum imbécile connard ordure estúpido basura imbécil".split()
)
SECOND = frozenset("you your yours u ur du dich dir ihr dein tu toi te vous ton votre usted tú vos".split())
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_TRIM = ".,;:!?()[]{}\"'*#%&$|<>-_/\\«»¡¿"
_MIXED = re.compile(r"[^\W\d_][\d@$*]+[^\W\d_]")
_LONG = re.compile(r"(\w)\1{3,}")
_SIGNS = re.compile(r"[^\w\s]")
N_FEATURES = 20


def features(text: str, learnt: frozenset[str]) -> list[float]:
    raw = text.split()
    n, chars = max(len(raw), 1), max(len(text), 1)
    low = [w.strip(_TRIM) for w in text.lower().split()]
    general = [i for i, w in enumerate(low) if w in GENERAL]
    found = [i for i, w in enumerate(low) if w in learnt]
    stems = [i for i, w in enumerate(low) if w[:STEM] + "~" in learnt]
    disguised = 0
    if len(_MIXED.findall(text)):
        for w in raw:
            if _MIXED.search(w):
                plain = w.lower().translate(_UNDO)
                disguised += plain in GENERAL or plain in learnt
    hits = sorted({*general, *found, *stems})
    second = [i for i, w in enumerate(low) if w in SECOND]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        far = np.minimum(np.abs(np.asarray([*second, 1 << 30])[at] - hits), np.abs(np.asarray([-(1 << 30), *second])[at] - hits))
        near = int((far <= 6).sum())
    signs = len(_SIGNS.findall(text))
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    return [
        len(general) / n, float(len(general)), len({low[i] for i in general}),
        len(found) / n, float(len(found)), len({low[i] for i in found}),
        len(stems) / n, float(len(stems)), len({low[i] for i in stems}),
        float(disguised), near / n, float(near), len(second) / n,
        sum(map(str.isupper, text)) / chars, signs / chars, text.count("!") / n, len(_LONG.findall(text)) / n,
        len(_MIXED.findall(text)) / n, same / n, log1p(len(raw)),
    ]


def _lexicon(sample: DataFrame) -> frozenset[str]:
    """The words and the stems (with a mark behind) whose share of documents of label 1 most exceeds that of label 0, by log odds; ``LEARNT`` of each at most."""
    words = F.expr(r"filter(transform(split(lower(text), '\\s+'), w -> regexp_replace(w, '^[^\\p{L}]+|[^\\p{L}]+$', '')), w -> length(w) between 3 and 40)")
    stems = F.transform(F.filter(words, lambda w: F.char_length(w) >= STEM), lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("~")))
    total = sample.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    if not total.p or not total.n:
        return frozenset()
    odds = (
        sample.select("label", F.explode(F.array_distinct(F.concat(words, stems))).alias("word"))
        .groupBy("word")
        .agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
        .where(F.col("p") >= max(3, total.p // 200))
        .withColumn("odds", F.log((F.col("p") + 0.5) / (total.p + 1)) - F.log((F.col("n") + 0.5) / (total.n + 1)))
        .where(F.col("odds") > 2.5)
        .withColumn("stem", F.col("word").endswith("~"))
    )
    best = lambda of: odds.where(of).orderBy(F.desc(F.col("odds") * F.log1p("p")), "word").limit(LEARNT)
    return frozenset(r.word for r in best(F.col("stem")).unionByName(best(~F.col("stem"))).select("word").collect())


def _as_features(learnt: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py() or "", learnt) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("aside"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "aside", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[frozenset[str], boosting.Boosted, np.ndarray, np.ndarray]:
    """Lexicon, trees and the knots of their calibration."""
    aside = F.pmod(F.xxhash64("doc_id", F.lit(ASIDE)), F.lit(5)) == 0
    sample = written(labelled_sample(docs, labels, "toxic", bound).withColumn("aside", aside).repartition(16, "doc_id"), "sample")
    learnt = _lexicon(sample.where(~F.col("aside")))
    rows = map_arrow(sample.select("text", "label", "aside"), _as_features(learnt), "label int, aside boolean, f array<double>").collect()  # `bound` rows of N_FEATURES numbers
    rows.sort(key=lambda r: (r.f, r.label, r.aside))
    x, y, aside = np.array([r.f for r in rows], float).reshape(-1, N_FEATURES), np.array([r.label for r in rows], float), np.array([r.aside for r in rows], bool)
    model = boosting.fit(x[~aside], y[~aside], rounds=60, depth=3, rate=0.15, least=2.0)
    return learnt, model, *boosting.isotonic(model.margin(x[aside]), y[aside])


def _scored(learnt: frozenset[str], model: boosting.Boosted, at: np.ndarray, rate: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "", learnt) for t in b.column("text")], float).reshape(-1, N_FEATURES)
            score = np.interp(model.margin(x), at, rate)
            rest = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest if n != "text"), pa.array(score)], names=[*(n for n in rest if n != "text"), "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; predicted is 1 from a score of one half."""
    model = fit(docs, labels, bound)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), whole_text().alias("text"))
    out = map_arrow(own, _scored(*model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted 0, with all their columns. The texts are scored where they lie: no join."""
    learnt, model, at, rate = fit(docs, labels, bound)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            x = np.array([features(t.as_py() or "", learnt) for t in text], float).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(np.interp(model.margin(x), at, rate) < 0.5))

    return map_arrow(docs, kept, docs.schema)
