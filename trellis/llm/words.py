"""Words of a text as arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column, between: str) -> Column:
    """What lies between the matches of ``between``, in order and without empty ones; A-Z are lower-cased and no other letter is.

    Texts are split at what is no word, as each match of ``regexp_extract_all`` copies the text that it is in: its time
    grows with the square of a long one. ``lower`` is quick but turns letters beyond ASCII too, so only words that it
    leaves alone are taken as they are; the few others are translated letter by letter.
    """
    found = F.filter(F.split(text, between, -1), lambda w: w != "")
    return F.transform(found, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, UPPER.lower())))
