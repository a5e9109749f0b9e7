"""Text operators as column functions: answer, score and tool-call parsing, tokens, tails, prompts.

Patterns and names below are fixed values: results depend on them to the letter. Java's ``\\b`` and ``\\w`` are made
Unicode-aware by ``(?U)`` where the rule asks for words of any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SINGLE = [
    (r"(?is)I select \(([A-D])\)", "I select (X)"),
    (r"(?is)answer is \(([A-D])\)", "answer is (X)"),
    (r"(?is)I select ([A-D])\b", "I select X"),
    (r"(?is)answer is ([A-D])\b", "answer is X"),
]
MULTI = [
    (r"(?i)I select \(([^)]+)\)", "I select (...)"),
    (r"(?i)I select ([A-F](?:\s*,\s*[A-F])*|NONE)\b", "I select ..."),
    (r"(?i)answer is \(([^)]+)\)", "answer is (...)"),
    (r"(?i)answer is ([A-F](?:\s*,\s*[A-F])*|NONE)\b", "answer is ..."),
]
SIGNALS = r"(?i)\b(select|answer|choose|option|go\s+with|pick|therefore|conclude|chosen|choice)\b"
JUDGE = [
    (r"(?is)(?:^|\n)\s*score[:\s]+([0-5])\b", "Score: N"),
    (r"(?is)final score[:\s]+([0-5])\b", "final score: N"),
    (r"(?is)\b([0-5])\s*/\s*5\b", "N/5"),
    (r"(?is)\b([0-5])\s+out\s+of\s+5\b", "N out of 5"),
    (r"(?is)I (?:give|assign|rate)[^\n]{0,40}\b([0-5])\b(?!\s*/)", "I give/assign N"),
]
THINKING = [r"(?s)<think>(.*?)</think>", r"(?s)<thinking>(.*?)</thinking>", r"(?s)<reasoning>(.*?)</reasoning>"]
STOP_WORDS = ["a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with"]
DISPLAYED = ("defected", "other")
FOOTNOTE = "\n\n*'other' includes non-standard or less common flavor categories"
TOOL_CALL = r"TOOL_CALL:\s*(\{(?:[^{}]|\{[^{}]*\})*\})"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_thinking(text: Column) -> Column:
    """struct(clean, thinking): thinking blocks out of the text; their contents, stripped, joined by blank lines, or null."""
    clean, blocks = text, []
    for p in THINKING:
        blocks.append(F.transform(F.regexp_extract_all(clean, F.lit(p), F.lit(1)), stripped))
        clean = F.regexp_replace(clean, p, "")
    every = F.concat(*blocks)
    none = text.isNull() | (text == "")
    return F.struct(
        F.when(none, text).otherwise(stripped(clean)).alias("clean"),
        F.when(~none & (F.size(every) > 0), F.array_join(every, "\n\n")).alias("thinking"),
    )


def strip_bold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*\(([^)]+)\)\*\*", "($1)")


def close_truncated(text: Column) -> Column:
    """A parenthesis of at most 30 characters left open at the end gets closed."""
    return F.regexp_replace(text, r"\(([^)\n]{1,30})\s*(?=\n?\z)\n?\z", "($1)")


#: Part of a model's name -> what is done to its answers.
NORMALISERS = {"mistral": [strip_bold], "gpt-oss": [close_truncated]}


def normalise_for_model(text: Column, model: Column) -> Column:
    for part, steps in NORMALISERS.items():
        done = text
        for f in steps:
            done = f(done)
        text = F.when(F.lower(model).contains(part), done).otherwise(text)
    return text


def tail_sentences(text: Column, n: int = 3) -> Column:
    """The last ``n`` sentences, joined by spaces."""
    parts = F.split(stripped(text), r"(?<=[.!?\n])\s+")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), " ")


def _first(options: list[tuple[Column, Column, str]], suffix: str = "") -> Column:
    """coalesce over (value, matched, name) of struct(answer, pattern, matched)."""
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("answer"), F.lit(name + suffix).alias("pattern"), m.alias("matched"))) for v, m, name in options))


def canonical_single(text: Column, suffix: str = "") -> Column:
    return _first([(F.upper(_group(text, p)), _group(text, p, 0), name) for p, name in SINGLE], suffix)


def letters_of(inner: Column) -> Column:
    """The letters A to F of a list; NONE is the empty list; null if there are none."""
    up = F.upper(stripped(inner))
    found = F.filter(F.transform(F.split(up, r"[,\s]+"), stripped), lambda x: x.rlike("^[A-F]$"))
    return F.when(up == "NONE", F.array().cast("array<string>")).when(F.size(found) > 0, found)


def canonical_multi(text: Column, suffix: str = "") -> Column:
    return _first([(letters_of(_group(text, p)), _group(text, p, 0), name) for p, name in MULTI], suffix)


def fallback_single(text: Column) -> Column:
    """The last letter in the last three sentences, if a signal word is there: low confidence."""
    tail = tail_sentences(text)
    gate = tail.rlike(SIGNALS)
    in_parens = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"(?i)\(([A-D])\)"), F.lit(1)), F.lit(-1))
    bare = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"(?i)\b([A-D])\b"), F.lit(1)), F.lit(-1))
    return _first([
        (F.when(gate, F.upper(in_parens)), F.concat(F.lit("("), in_parens, F.lit(")")), "Last (X) [low-confidence]"),
        (F.when(gate, F.upper(bare)), bare, "Last letter [low-confidence]"),
    ])


def parse_single(text: Column, thinking: Column, model: Column) -> Column:
    """struct(answer, pattern, matched) of a single-choice response: as written, normalised for the model, in the thinking, fallback."""
    raw = F.coalesce(text, F.lit(""))
    return F.coalesce(canonical_single(raw), canonical_single(normalise_for_model(raw, model), " [normalized]"), canonical_single(thinking, " [thinking]"), fallback_single(raw))


def parse_multi(text: Column, thinking: Column, model: Column) -> Column:
    """struct(answer array, pattern, matched) of a multi-select response; there is no fallback."""
    raw = F.coalesce(text, F.lit(""))
    return F.coalesce(canonical_multi(raw), canonical_multi(normalise_for_model(raw, model), " [normalized]"), canonical_multi(thinking, " [thinking]"))


def parse_judge_score(text: Column) -> Column:
    """struct(answer int, pattern, matched): the first pattern that matches, else the last single digit 0 to 5."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([0-5])\b"), F.lit(1)), F.lit(-1))
    found = [(_group(text, p).cast("int"), stripped(_group(text, p, 0)), name) for p, name in JUDGE]
    return _first([*found, (last.cast("int"), last, "last digit")])


def parse_tool_call(text: Column) -> Column:
    """struct(name, args): the first written tool call with a name; args is a JSON object, {} if it is none."""
    body = _group(text, TOOL_CALL)
    name = F.get_json_object(body, "$.name")
    args = F.get_json_object(body, "$.args")
    quoted = body.rlike(r'"name"\s*:\s*"')
    return F.when(quoted & (name != ""), F.struct(name.alias("name"), F.when(args.startswith("{"), args).otherwise(F.lit("{}")).alias("args")))


def tool_result(payload: Column) -> Column:
    return F.concat(F.lit("TOOL_RESULT: "), payload)


def tokens(text: Column) -> Column:
    """The distinct words of a text in lower case, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def words(text: Column) -> Column:
    return F.array_distinct(F.split(stripped(F.lower(text)), r"\s+"))


def squashed(text: Column) -> Column:
    return F.translate(F.lower(text), " -", "")


def answer_format_hint(text: Column) -> Column:
    """What follows the last blank line, with that line; empty if there is none."""
    parts = F.split(text, "\n\n")
    return F.when(F.size(parts) > 1, F.concat(F.lit("\n\n"), F.element_at(parts, -1))).otherwise(F.lit(""))


def fill(template: str, **values: Column) -> Column:
    out: Column = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def short_task(task_type: Column, id_: Column) -> Column:
    """The task's short name: what stands before the first underscore of the type, else of the id."""
    return F.upper(F.split_part(F.coalesce(F.nullif(task_type, F.lit("")), id_), F.lit("_"), F.lit(1)))


def short_model(model: Column) -> Column:
    return F.substring_index(model, "/", -1)


def truncated(text: Column, n: int = 100) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.when(F.char_length(text) > n, "...").otherwise(""))


def display_path(path: Column, root: str) -> Column:
    """A path without the root, with the display name of one category, as one string."""
    return F.array_join(F.transform(F.filter(path, lambda x: x != root), lambda x: F.when(x == DISPLAYED[0], DISPLAYED[1]).otherwise(x)), " > ")


def stable_id(prefix: Column, *keys: Column) -> Column:
    """prefix_ and eight hex digits that follow from the keys."""
    return F.concat(prefix, F.lit("_"), F.left(F.md5(F.concat_ws("|", *keys)), F.lit(8)))


def centred(text: Column, width: int, pad: str = " ") -> Column:
    """``text`` in the middle of ``width``; of an odd number of pads the extra one is on the right for an even width, else on the left."""
    n = F.greatest(F.lit(width) - F.char_length(text), F.lit(0))
    left = (n / 2).cast("int") + n.bitwiseAND(F.lit(width & 1))
    return F.concat(F.repeat(F.lit(pad), left), text, F.repeat(F.lit(pad), n - left))


def with_footnote(text: Column, options: Column, whole: bool = True) -> Column:
    """The text, and what ``other`` means if it is an option or, unless options are looked at as a ``whole``, in one."""
    has = F.array_contains(options, DISPLAYED[1]) if whole else F.exists(options, lambda o: o.contains(DISPLAYED[1]))
    return F.concat(text, F.when(F.coalesce(has, F.lit(False)), FOOTNOTE).otherwise(""))


def display_nodes(option: Column) -> Column:
    """An option with each node by its displayed name, in paths and rankings too."""
    return F.regexp_replace(option, rf"(^| > | → ){DISPLAYED[0]}(?= > | → |$)", f"$1{DISPLAYED[1]}")
