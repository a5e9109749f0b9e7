"""PII: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans (email, ip, card, phone, by fixed expressions and checks) always stay. Looser generators propose spans that
may overlap them and each other: mail addresses with a written "at", a spaced sign or a bare host, any four numbers
with dots and addresses of version 6, any 13 to 19 digits, telephone numbers in national form. Trees score each
proposal by its format and the words and characters around it, and a threshold for its kind decides; accepted ones
that overlap no base span of their kind are added.

No table marks personal data, so the evidence is in the texts: of the proposals in all documents, repeated ones too,
those that overlap a validated span of their kind are examples for; those that fail their kind's check (Luhn, parts
over 255, no domain, too few or many digits, joined to letters) or overlap a span of another kind are examples
against; the rest are what is to be decided. To these come examples made by a fixed rule, for formats that the texts
lack. Half of all is for the trees, half for the thresholds, which ask for ``precision`` among the real examples of a
kind or, where a kind has fewer than ``FEW`` of either label, among the made ones. ``decisions`` counts what was
proposed, accepted and rejected. Examples are counted by label and features in a first pass over the documents; only counts
leave it, as many as there are combinations of features, of which each has a bound. The trees end as one SQL expression, so
that the second pass is a map over the documents: no shuffle of texts, no Python on the executors.

Nulls: a null text counts as empty and has no spans. Other columns, repeated rows and null ids pass through; in
``find_pii`` an input column that has the name of a result column is replaced. Names that begin with ``_trellis_``
are the operators' own. An empty table gives an empty result.
Adjacent matches of a kind are found leftmost, non-overlapping, in time linear in the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import whole_text
from .spans import LUHN, digits_where, joined, located, with_matches

KINDS = ("email", "ip", "card", "phone")
#: Base expressions of the contract, in possessive form.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_KEEP = {
    "email": "true",
    "ip": f"x._trellis_m_ip rlike r'^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$'",
    "card": digits_where("x._trellis_m_card", f"length(d) between 16 and 19 and {LUHN}"),
    "phone": digits_where("x._trellis_m_phone", "length(d) between 8 and 15"),
}
#: Generators of proposals.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[(\[{]at[)\]}]\x20?[a-z0-9-]{1,63}+(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,6}+|\x20at\x20[a-z0-9-]{1,63}+(?:\x20dot\x20[a-z0-9-]{1,63}+){1,6}+|\x20?@\x20?[a-z0-9-]{1,63}+(?:\.[a-z0-9-]{1,63}+){0,6}+)",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}+|[0-9]{1,5}+(?:\.[0-9]{1,5}+){3}+)(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-]\x20?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}+(?![0-9])",
}
#: Examples of each label that a threshold asks for.
FEW = 15
_CUES = {
    "email": "mail|contact|kontakt|write|reach|correo|courriel",
    "ip": "ip|host|server|address|login|client|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|mobile|fax|cell|ring|movil|anruf|appel",
}
_AGAINST = "order|invoice|version|isbn|ref|serial|part|item|page|total|id|build|look|arrive|meet|stay"
FEATURES = ("digits", "luhn", "breaks", "cue", "against", "joined_left", "joined_right", "parens", "marked_at", "distinct_digits", "zero_first", "tld", "dotted", "sign_at")


def _features(kind: str) -> str:
    """SQL of the struct of features of the proposal ``x`` (left, m, right)."""
    d = "regexp_replace(x.m, '[^0-9]', '')"
    before = "lower(right(x.left, 24))"
    return f"""named_struct(
        'digits', cast(least(length({d}), 40) as double),
        'luhn', if(length({d}) between 13 and 19 and {digits_where("x.m", LUHN)}, 1D, 0D),
        'breaks', cast(least(length(regexp_replace(x.m, '[A-Za-z0-9]', '')), 12) as double),
        'cue', if({before} rlike r'(?:{_CUES[kind]})[^.]{{0,12}}$', 1D, 0D),
        'against', if({before} rlike r'\\b(?:{_AGAINST})\\b[^.]{{0,8}}$', 1D, 0D),
        'joined_left', if(x.left rlike r'[A-Za-z0-9_]$', 1D, 0D),
        'joined_right', if(x.right rlike r'^[A-Za-z0-9_]', 1D, 0D),
        'parens', if(contains(x.m, '('), 1D, 0D),
        'marked_at', if(x.m rlike r'(?i)[(\\[{{]at[)\\]}}]', 1D, 0D),
        'distinct_digits', cast(size(array_distinct(split({d}, ''))) as double),
        'zero_first', if({d} like '0%', 1D, 0D),
        'tld', if(x.m rlike r'(?i)(?:com|org|net|edu|gov|de|fr|es|io|uk|example)$', 1D, 0D),
        'dotted', if(x.m rlike '[0-9][.][0-9]', 1D, 0D),
        'sign_at', if(contains(x.m, '@'), 1D, 0D))"""


#: What a proposal ``x`` that overlaps no base span of its kind fails, as SQL.
_FAILS = {
    "email": "x.f.sign_at = 1",
    "ip": "x.f.dotted = 1",
    "card": "x.f.luhn = 0",
    "phone": "x.f.digits < 7 or x.f.digits > 15 or x.f.joined_left = 1 or x.f.joined_right = 1",
}


def _overlaps(kind: str) -> str:
    return f"exists(_trellis_base_{kind}, b -> b.s < x.e and x.s < b.e)"


def _label(kind: str) -> str:
    """SQL: 1, 0 or null for the proposal ``x``."""
    others = " or ".join(_overlaps(k) for k in KINDS if k != kind)
    return f"case when {_overlaps(kind)} then 1 when {others} or {_FAILS[kind]} then 0 end"


def _proposed(df: DataFrame) -> DataFrame:
    """Adds ``_trellis_c_kind``: the proposals of each kind as structs (s, e, left, m, right, f)."""
    gates = {
        "email": F.col("text").rlike(r"(?i)[(\[{\x20]at[)\]}\x20]|@"),
        "ip": F.col("text").rlike(r"(?i)[0-9a-f]:[0-9a-f]{1,4}:|[0-9]\.[0-9]"),
        "card": F.col("text").rlike("[0-9]"),
        "phone": F.col("text").rlike("[0-9]"),
    }
    for k in KINDS:
        df = with_matches(df, f"l_{k}", LOOSE[k], gates[k])
        p, m = f"_trellis_p_l_{k}", f"_trellis_m_l_{k}"
        df = df.withColumn(f"_trellis_s_{k}", F.expr(located(f"l_{k}"))).withColumn(
            f"_trellis_c_{k}",
            F.expr(f"""transform(transform(_trellis_s_{k}, (y, i) -> named_struct('s', y.s, 'e', y.e, 'left', right({p}[i], 40), 'm', {m}[i], 'right', left({p}[i + 1], 8))),
                x -> named_struct('s', x.s, 'e', x.e, 'f', {_features(k)}))"""),
        )
    return df


def _examples(spark: SparkSession, n: int) -> DataFrame:
    """(text, kind, label): labelled examples by a fixed rule over 0..n-1; half positive."""
    h = lambda k, m: f"cast(pmod(xxhash64(id, {k}), {m}) as int)"
    dig = lambda k, n: f"lpad(cast(pmod(xxhash64(id, {k}), {10**n}) as string), {n}, '0')"
    pick = lambda k, words: f"element_at(array({', '.join(repr(w) for w in words)}), 1 + {h(k, len(words))})"
    body = f"substring(concat('4', {dig(11, 7)}, {dig(12, 6)}), 1, 12 + {h(14, 3)})"
    last = """(10 - aggregate(sequence(1, length(b)), 0, (t, i) -> t + if((length(b) - i) % 2 = 1, cast(substring(b, i, 1) as int),
        cast(substring(b, i, 1) as int) * 2 - if(substring(b, i, 1) > '4', 9, 0))) % 10) % 10"""
    number = f"element_at(transform(array({body}), b -> concat(b, cast(({last} + if({h(2, 2)} = 1, 0, 1 + {h(15, 9)})) % 10 as string))), 1)"
    return spark.range(n).selectExpr(
        f"element_at(array('email', 'ip', 'card', 'phone'), 1 + {h(1, 4)}) kind", f"{h(2, 2)} label", f"{h(3, 2)} half",
        f"""concat({pick(4, ["the ", "please see ", "und der ", "avec "])}, case {h(1, 4)}
            when 0 then if({h(2, 2)} = 1,
                concat({pick(5, ["mail ", "contact ", "write to ", "- "])}, 'n', {dig(6, 2)}, {pick(7, [" (at) ", "(at)", " [at] ", " at "])}, 'host', {dig(8, 1)}, {pick(9, [" dot ", " dot "])}, {pick(10, ["com", "org", "net", "de"])}),
                concat({pick(5, ["look", "arrive", "meet", "stay"])}, ' at ', {pick(7, ["one", "each", "this", "that"])}, ' dot ', {pick(10, ["then", "and", "we", "he"])}))
            when 1 then if({h(2, 2)} = 1,
                concat({pick(5, ["host ", "server ", "from ", "ip "])}, substring(sha2(cast(id as string), 256), 1, 4), ':', substring(sha2(cast(id as string), 256), 5, 4), ':0:0:1:', {dig(8, 2)}, ':a', {dig(9, 1)}, ':1'),
                concat({pick(5, ["at ", "time "])}, '1:2:3:4:5:6:7:', {dig(9, 1)}, {pick(10, ["x", "z", "q"])}))
            when 2 then if({h(2, 2)} = 1,
                concat({pick(5, ["card ", "visa ", "pay by ", ""])}, {number}),
                concat({pick(5, ["order ", "serial ", "card ", ""])}, {number}))
            else if({h(2, 2)} = 1,
                concat({pick(5, ["call ", "tel ", "phone: ", "fax "])}, {pick(7, ["(0", "(5"])}, {dig(8, 2)}, ') ', {dig(9, 3)}, '-', {dig(10, 4)}),
                concat({pick(5, ["order ", "page ", "item ", "total "])}, {dig(8, 3)}, {pick(7, [" ", "-", "."])}, {dig(9, 3)}, {pick(6, [" ", "-"])}, {dig(10, 3)})) end,
            {pick(13, [" and so on", ".", ", then", " - "])}) text""",
    )


@lru_cache(maxsize=8)
def _made(spark: SparkSession, examples: int) -> list[Row]:
    """(half, label, k, features, count) of the examples made by rule."""
    return _counted(_proposed(_examples(spark, examples)), lambda k: f"if(kind = '{k}', label, null)")


def _counted(proposed: DataFrame, label) -> list[Row]:
    """How often each combination of half, label, kind and features is there; proposals without a label don't count."""
    every = F.concat(*(F.expr(f"transform(_trellis_c_{k}, x -> named_struct('label', {label(k)}, 'k', {i}, 'f', x.f))") for i, k in enumerate(KINDS)))
    rows = proposed.select("half", F.explode(F.filter(every, lambda x: x["label"].isNotNull())).alias("c")).select("half", "c.label", "c.k", "c.f.*")
    return sorted(rows.groupBy("half", "label", "k", *FEATURES).count().collect())


def _based(df: DataFrame) -> DataFrame:
    """Adds ``_trellis_base_kind``."""
    has = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9]"), "phone": F.contains("text", F.lit("+"))}
    for k in KINDS:
        df = with_matches(df, k, BASE[k], has[k]).withColumn(f"_trellis_base_{k}", F.expr(located(k, _KEEP[k])))
    return df


def _real(docs: DataFrame) -> list[Row]:
    """As ``_made``, of the proposals in all documents; copies of a text are in one half. Texts without three digits near each other or an @ have none with a label."""
    texts = docs.select(whole_text().alias("text")).where(F.col("text").rlike(r"[0-9][\x20.()-]{0,2}[0-9][\x20.()-]{0,2}[0-9]|@"))
    return _counted(_proposed(_based(texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))), _label)


def _trained(docs: DataFrame, examples: int, precision: float) -> tuple[str, dict[str, float]]:
    """The trees as SQL, and each kind's threshold."""
    table = lambda rows: np.array([[float(v) for v in r] for r in rows]).reshape(-1, 4 + len(FEATURES))
    made, real = table(_made(docs.sparkSession, examples)), table(_real(docs))
    for data in (made, real):  # the order of columns is half, label, k, features, count
        data[:, -1] *= examples / max(1.0, data[:, -1].sum())  # both weigh alike
    first = np.vstack([d[d[:, 0] == 0] for d in (made, real)])
    model = boosting.fit(first[:, 2:-1], first[:, 1], first[:, -1], rounds=32, depth=4, rate=0.3)
    cuts = {}
    for i, k in enumerate(KINDS):
        held = [d[(d[:, 0] == 1) & (d[:, 2] == i)] for d in (real, made)]
        own = held[0] if min((held[0][:, 1] == y).sum() for y in (0, 1)) and len(held[0]) >= FEW else held[1]
        score, y, w = model.score(own[:, 2:-1]), own[:, 1], own[:, -1]
        good = [t for t in np.unique(score) if (w * y)[score >= t].sum() >= precision * w[score >= t].sum()]
        cuts[k] = max(0.5, float(min(good))) if good else 2.0  # no threshold reaches it: nothing is added
    return model.sql(["_kind", *(f"x.f.{f}" for f in FEATURES)]), cuts


def _scored(docs: DataFrame, examples: int, precision: float) -> tuple[DataFrame, dict[str, str]]:
    """``docs``, null texts empty, with base spans and proposals, and SQL that says of a proposal ``x`` whether it is accepted."""
    score, cuts = _trained(docs, examples, precision)
    accepted = {k: f"{score.replace('_kind', f'{i}D')} >= {cuts[k]!r}D" for i, k in enumerate(KINDS)}
    return _proposed(_based(docs.withColumn("text", whole_text()))), accepted


def _found(docs: DataFrame, examples: int = 4000, precision: float = 0.98) -> DataFrame:
    """``docs``, null texts empty, with ``_trellis_base_kind`` and ``_trellis_all_kind``."""
    df, accepted = _scored(docs, examples, precision)
    for k in KINDS:
        more = f"transform(filter(_trellis_c_{k}, x -> not {_overlaps(k)} and {accepted[k]}), y -> named_struct('s', y.s, 'e', y.e))"
        df = df.withColumn(f"_trellis_all_{k}", F.expr(f"array_sort(concat(_trellis_base_{k}, {more}))"))
    return df


def decisions(docs: DataFrame, examples: int = 4000, precision: float = 0.98) -> DataFrame:
    """(kind, label, accepted, proposals): how many proposals the trees accept and reject, by what the text itself says of them (1, 0, or null where it says nothing)."""
    df, accepted = _scored(docs, examples, precision)
    every = F.concat(*(F.expr(f"transform(_trellis_c_{k}, x -> named_struct('kind', '{k}', 'label', {_label(k)}, 'accepted', {accepted[k]}))") for k in KINDS))
    return df.select(F.explode(every).alias("d")).groupBy("d.kind", "d.label", "d.accepted").agg(F.count("*").alias("proposals"))


def find_pii(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with ``base_kind`` and ``all_kind`` for each kind: arrays of (s, e), code points, end exclusive.

    ``all_kind`` has the base spans and the accepted proposals that overlap no base span of their kind.
    """
    fresh = [f"{a}_{k}" for k in KINDS for a in ("base", "all")]
    found = _found(docs, **options)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c not in fresh), *(F.col(f"_trellis_{c}").alias(c) for c in fresh))


def redact(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; spans that overlap are replaced as one.

    Columns and rows are those of ``docs``; ``n_chars``, where there is one, follows the new text.
    """
    every = ", ".join(f"transform(_trellis_all_{k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '[{k.upper()}]'))" for k in KINDS)
    merged = f"""aggregate(array_sort(concat({every})), cast(array() as array<struct<s:int,e:int,k:string>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).e > x.s,
           concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'k', element_at(a, -1).k))),
           concat(a, array(x))))"""
    at = "_trellis_spans"
    out = _found(docs, **options).withColumn(at, F.expr(merged)).withColumn(
        "_trellis_new",
        F.expr(f"""if(size({at}) = 0, text, concat(
            array_join(transform({at}, (x, i) -> concat(substring(text, if(i = 0, 0, {at}[i - 1].e) + 1, x.s - if(i = 0, 0, {at}[i - 1].e)), x.k)), ''),
            substring(text, element_at({at}, -1).e + 1)))"""),
    )
    replaced = {"text": F.col("_trellis_new")} | ({"n_chars": F.char_length("_trellis_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The digest: counts and hash of the base spans, and all spans."""
    found = find_pii(docs)
    base, every = ({k: f"{a}_{k}" for k in KINDS} for a in ("base", "all"))
    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(joined(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined(every)).alias("spans"),
    )
