"""Positions of regular-expression matches, as column expressions.

``regexp_extract_all`` has the matches and ``split`` by the same expression the texts between them; a running
sum over both gives every position in code points, inside the row, with no shuffle and no Python.

Expressions are written so that the regex engine needs linear time and no recursion: possessive loops where
nothing after them can match what they took, and a look-behind (or the end of the last match, ``\\G``) in front of
runs, so that no run is entered in its middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "cast(array() as array<struct<s:int,e:int>>)"


def with_matches(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds ``_trellis_p_name`` (texts between matches) and ``_trellis_m_name`` (matches) where ``gate`` holds, else nulls."""
    return df.withColumns(
        {
            f"_trellis_p_{name}": F.when(gate, F.split("text", pattern, -1)),
            f"_trellis_m_{name}": F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
        }
    )


def located(name: str, keep: str = "true") -> str:
    """SQL of the array of (s, e) of the matches of ``name``; ``keep`` is a condition on the match ``x._trellis_m_name``."""
    p, m = f"_trellis_p_{name}", f"_trellis_m_{name}"
    start = f"a.pos + coalesce(length(x.{p}), 0)"
    end = f"{start} + coalesce(length(x.{m}), 0)"
    return f"""coalesce(aggregate(arrays_zip({p}, {m}), named_struct('pos', 0, 'out', {NONE}),
        (a, x) -> named_struct('pos', {end}, 'out', if(x.{m} is not null and ({keep}),
            concat(a.out, array(named_struct('s', {start}, 'e', {end}))), a.out)),
        a -> a.out), {NONE})"""


def digits_where(text: str, condition: str) -> str:
    """SQL of ``condition`` on ``d``, the digits of ``text``."""
    return f"element_at(transform(array(regexp_replace({text}, '[^0-9]', '')), d -> {condition}), 1)"


#: Luhn's checksum of the digits ``d``.
LUHN = """aggregate(sequence(1, length(d)), 0, (t, i) -> t + if((length(d) - i) % 2 = 0,
    cast(substring(d, i, 1) as int),
    cast(substring(d, i, 1) as int) * 2 - if(substring(d, i, 1) > '4', 9, 0))) % 10 = 0"""


def joined(kinds: dict[str, str]) -> str:
    """SQL of kind:start:end by kind as listed, then start, joined by commas; ``kinds`` maps a kind to its array column."""
    return "concat_ws(',', " + ", ".join(f"transform({c}, x -> concat('{k}:', x.s, ':', x.e))" for k, c in kinds.items()) + ")"
