"""Fill-in-middle: texts cut into units, and prefix, suffix and middle put into an order that a model completes.

An Arrow-batched pandas UDF works on one text at a time: the ends of its units (``regex.finditer``) go into a compact
array of 8 bytes each, two look-ups there give the ends of prefix and middle, and the text is cut by slices. All
choices come from SHA-256 of a seed and the document's id, so that they don't depend on the cluster, and a repeated
row is cut alike. Nothing is shuffled.

A text that is empty, that holds one of the marks, or that the rate leaves out stays as it is (``plain``). Since no
mark is in the text, an output says by itself where its parts lie: ``restored`` gives the exact text back.

Nulls: a null text is an empty one, a null id counts as no digits. Units must cover the text without gaps, which is
checked; a text's last unit may lack its end. Columns of the input that have a result column's name are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import whole_text

#: Lines with their ends; the last may have none.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_FOUND = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def seeds(doc_id: str, seed: int) -> list[int]:
    """Four numbers below 2^32 from the hash of the seed and the id."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    ends, at = array("Q"), 0
    for m in unit.finditer(text):
        if m.start() != at or m.end() == at:
            raise ValueError("units must cover the text without gaps")
        at = m.end()
        ends.append(at)
    if at != len(text):
        raise ValueError("units must cover the text without gaps")
    return ends


def cut(text: str, doc_id: str, unit: regex.Pattern, seed: int = 7, rate: int = 100, suffix_first: int = 50) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, number of units, characters of prefix, characters of middle)."""
    ends, (h1, h2, h3, h4) = unit_ends(text, unit), seeds(doc_id, seed)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return text, "plain", n, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, a, b - a


def restored(output: str, form: str) -> str:
    """The text that was cut, from the output and its form alone. No mark can begin or end inside another, so the first found is the right one."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with {one}")
    i = output.index(two, len(one))
    j = output.index(MIDDLE, i + len(two))
    head, tail, middle = output[len(one) : i], output[i + len(two) : j], output[j + len(MIDDLE) :]
    return head + middle + tail if form == "psm" else tail + middle + head


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cutter(unit: str, seed: int, rate: int, suffix_first: int, with_output: bool):
    """The pandas UDF of (id, text); the outputs themselves come back only on demand, their hashes always."""
    pattern = regex.compile(unit)

    def cut_batch(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, t in zip(ids, texts, strict=True):
            out, form, n, a, m = cut(t, i, pattern, seed, rate, suffix_first)
            rows.append((n, form, a, m, _sha(out), _sha(restored(out, form)), *([out] if with_output else [])))
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if with_output else [])])
        return found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(cut_batch, _FOUND + (", output string" if with_output else ""))


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, suffix_first: int = 50, with_output: bool = True) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, unless it isn't wanted, output.

    ``rate`` and ``suffix_first`` are in hundredths: how many documents are cut, how many of these begin with the suffix.
    """
    if not (0 <= rate <= 100 and 0 <= suffix_first <= 100):
        raise ValueError("rates are from 0 to 100")
    shipped(docs.sparkSession)
    found = cutter(unit, seed, rate, suffix_first, with_output)(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text())
    names = [x.split()[0] for x in _FOUND.split(", ")] + (["output"] if with_output else [])
    out = docs.withColumn("_trellis_cut", found)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), *(F.col(f"_trellis_cut.{c}").alias(c) for c in names))


def restore(output: Column, form: Column) -> Column:
    """``restored`` as a column of texts."""

    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return F.pandas_udf(back, "string")(output, form)


def report(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs.select("doc_id", "text"), with_output=False).drop("text")


ORACLE = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                      sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units),
places AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
                 array_to_string(list_slice(u, b + 1, n), '') AS s FROM places)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
