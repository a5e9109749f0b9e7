"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived (which trigrams must every match have?).
The index is a table of postings in the shared folder, (trigram, row), for the trigrams that some query asks for, in
order of the trigram within a file. For each way of a query (an AND of trigrams) the lists of its trigrams are
intersected: rows that are in all of them are candidates of the rule. Only candidates are joined with their texts
again and verified with the expression, each by the rules it is a candidate of. A rule without mandatory trigrams (a
run of hex digits) scans every text. Everything is DataFrame expressions. A row is known by 128 bits of hash of its
id and text, so that copies of one text under many ids do not meet in one group.

Nulls: a null text counts as empty and has no spans. Repeated rows are verified once and give repeated result rows.
Other columns pass through; one that has a result column's name is replaced. An empty table gives an empty result. Matches are leftmost
and non-overlapping per kind.
"""

from __future__ import annotations

from re import _constants as rc
from re import _parser as rp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .spans import NONE, located, with_matches

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> expression. The first three are the base; runs below the least length cannot match.
RULES = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "forge": r"gh[opsu]_[A-Za-z0-9]{36,}+",
    "chat": r"xox[abps]-[A-Za-z0-9-]{10,}+",
    "payment": r"[rs]k_live_[A-Za-z0-9]{16,}+",
    "cloud": r"AIza[A-Za-z0-9_-]{35,}+",
    "web": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "key": r"-----BEGIN[A-Z\x20]{1,30}PRIVATE\x20KEY-----",
}
_KEEP = {"assign": f"length(regexp_extract(x._trellis_m_assign, r'''{_ASSIGN}''', 1)) >= 6".replace("r'''", "r'").replace("'''", "'").replace('["\']', '["\\x27]')}

Query = frozenset[frozenset[str]]  # an OR of ANDs of trigrams; {frozenset()} holds for every text
ANY: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(p: Query, q: Query, most: int = 64) -> Query:
    if len(p) * len(q) > most:  # weaker, but still true of every match
        return p if len(p) <= len(q) else q
    return _least(frozenset(a | b for a in p for b in q))


def _of_strings(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _derive(nodes, most: int = 64) -> tuple[frozenset[str] | None, Query]:
    """Of a sequence of parsed nodes: all strings it can match, lower-case (None: too many), and its query."""
    query, run, exact = ANY, frozenset([""]), True
    for op, arg in nodes:
        strings, own = None, ANY
        if op is rc.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = frozenset(chr(a).lower() for _, a in arg)
        elif op is rc.SUBPATTERN:
            strings, own = _derive(arg[-1])
        elif op is rc.BRANCH:
            parts = [_derive(b) for b in arg[1]]
            strings = frozenset().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            own = _least(frozenset().union(*(_of_strings(s) if s is not None else q for s, q in parts)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inside, q = _derive(inner)
            if high == 1 and low == 0 and inside is not None:
                strings = inside | {""}
            elif low >= 1:
                own = _of_strings(inside) if inside is not None else q
        elif op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            strings = frozenset([""])
        if strings is not None and len(strings) * len(run) <= most:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
        run, exact = frozenset([""]), False
    return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, of the text in lower case, that a match of ``pattern`` must have, as an OR of ANDs."""
    strings, query = _derive(rp.parse(pattern))
    return _of_strings(strings) if strings is not None else query


KEY = ["_trellis_k1", "_trellis_k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs``, null texts empty, with the two halves of a row's key."""
    df = docs.withColumn("text", whole_text())
    return df.withColumns({KEY[0]: F.xxhash64("doc_id", "text"), KEY[1]: F.xxhash64(F.lit(9), "text", "doc_id")})


def indexed_rules() -> dict[str, Query]:
    """The rules that the index serves, with their queries."""
    return {k: q for k, p in RULES.items() if frozenset() not in (q := trigram_query(p))}


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the index of ``rows`` for the given trigrams, one row for each text that has it."""
    low = rows.select(*KEY, F.lower("text").alias("_trellis_low"))
    has = F.array_compact(F.array(*(F.when(F.contains("_trellis_low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(has).alias("trigram"), *KEY).sortWithinPartitions("trigram")


def candidates(rows: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, _trellis_rules): the rows that are in all lists of some way of a rule's query, from the written index."""
    ways = [(t, i, len(a), k) for i, (k, a) in enumerate((k, a) for k, q in sorted(queries.items()) for a in sorted(q, key=sorted)) for t in sorted(a)]
    index = written(postings(rows, sorted({w[0] for w in ways})), "postings")
    asked = rows.sparkSession.createDataFrame(ways, "trigram string, way int, size long, rule string")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(asked), "trigram").repartition(*KEY).groupBy(*KEY, "way", "size", "rule").agg(F.size(F.collect_set("trigram")).alias("n"))  # repeated rows have one key
    return met.where("n = size").groupBy(*KEY).agg(F.collect_set("rule").alias("_trellis_rules"))


def verified(rows: DataFrame, found: DataFrame, rules: list[str]) -> DataFrame:
    """(key, _trellis_at_kind for each rule): the spans of the candidates; other texts are not looked at."""
    df = rows.select(*KEY, "text").join(found, KEY).dropDuplicates(KEY)
    for k in rules:
        df = with_matches(df, k, RULES[k], F.array_contains("_trellis_rules", k)).withColumn(f"_trellis_at_{k}", F.expr(located(k, _KEEP.get(k, "true"))))
    return df.select(*KEY, *(f"_trellis_at_{k}" for k in rules))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``at_kind`` for each rule: an array of (s, e), code points, end exclusive."""
    rows, queries = keyed(docs), indexed_rules()
    found = written(candidates(rows, queries), "candidates")
    at = verified(rows, found, list(queries))
    df = rows
    for k in RULES:
        if k not in queries:
            df = with_matches(df, k, RULES[k], F.lit(True)).withColumn(f"_trellis_at_{k}", F.expr(located(k, _KEEP.get(k, "true"))))
    df = df.join(at, KEY, "left")
    fresh = [f"at_{k}" for k in RULES]
    none = F.expr(NONE)
    return df.select(*(F.col(f"`{c}`") for c in docs.columns if c not in fresh), *(F.coalesce(F.col(f"_trellis_{c}"), none).alias(c) for c in fresh))


def _listed(kinds: tuple[str, ...]) -> str:
    every = ", ".join(f"transform(at_{k}, x -> named_struct('s', x.s, 'o', {i}, 'e', x.e, 'k', '{k}'))" for i, k in enumerate(kinds))
    return f"array_join(transform(array_sort(concat({every})), x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """The digest: counts and hash of the base spans, and all spans, by start, then kind as listed."""
    return find_secrets(docs).select(
        "doc_id",
        *(F.size(f"at_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.expr(_listed(BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listed(tuple(RULES))).alias("spans"),
    )
