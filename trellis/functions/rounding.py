"""Rounding of doubles to decimal places by their exact value, half to even, as Python's ``round`` does.

A double is m * 2^-k. Multiplied by 10^n it is m * 5^n over 2^(k - n): a whole number, which is rounded to itself, or a
fraction whose remainder says exactly on which side of the half it lies. Both parts are decimals, so nothing is rounded
twice. ``round`` of Spark and of SQL rounds the shortest decimal that reads as the double, which is another
number: 2.675 is less than it says and rounds to 2.67.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PLACES = 4


def rounded(name: str, places: int) -> Column:
    """The column ``name``, a double, to ``places`` decimal places (0 to 4); null, infinity and what isn't a number stay as they are."""
    if not 0 <= places <= MOST_PLACES:
        raise ValueError(f"places must be from 0 to {MOST_PLACES}")
    power = lambda s: f"cast(shiftleft(1L, least({s}, 40)) as decimal(13,0)) * cast(shiftleft(1L, greatest({s} - 40, 0)) as decimal(11,0))"
    whole = f"cast(cast(s.a * pow(2D, s.k) as bigint) as decimal(18,0)) * cast({5**places} as decimal(4,0))"  # 2^53 to 2^55 times 5^n
    up = "if(2 * u.r > t.d or (2 * u.r = t.d and u.q % 2 = 1), 1, 0)"
    near = f"""element_at(transform(array(named_struct('n', {whole}, 'd', {power(f's.k - {places}')})), t ->
        element_at(transform(array(named_struct('q', t.n div t.d, 'r', t.n % t.d)), u -> cast(cast(u.q + {up} as decimal(20,0)) * cast({10.0**-places:.{places}f} as decimal(5,4)) as double)), 1)), 1)"""
    size = f"transform(array(abs(cast(`{name}` as double))), a -> named_struct('a', a, 'k', if(a > 0 and a < double('infinity'), cast(53 - floor(log2(a)) as int), null)))"
    # above 2^72 of the denominator less than half of a last place is left
    return F.expr(f"""element_at(transform({size}, s -> case when s.k is null or s.k <= {places} then cast(`{name}` as double)
        else if(`{name}` < 0, -1D, 1D) * if(s.k - {places} > 72, 0D, {near}) end), 1)""")
