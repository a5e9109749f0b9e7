"""Prompts, displays and messages as column functions; wordings are parameters with plain defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


@dataclass(frozen=True)
class Wording:
    """Templates with {names} in braces; braces that are no name stay as they are."""

    single: str = "End with: I select (X). X is {options_list}."
    multi: str = "End with: I select (X, Y). Choose all that apply of {options_list}, or NONE."
    open: str = "Answer in a few sentences."
    budget: str = "Traversal calls are limited."
    closing: str = "End with a line: Score: N, with N from 0 to 5."
    result: str = "TOOL_RESULT: "
    extra: dict[str, str] = field(default_factory=dict)


def rendered(template: str, **values: str) -> str:
    """``template`` with the known names filled in; other braces, as those of JSON, stay."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def keys_sorted(options: Column) -> Column:
    return F.array_sort(F.map_keys(options))


def options_lines(options: Column, indent: str = "") -> Column:
    return F.array_join(F.transform(keys_sorted(options), lambda k: F.concat(F.lit(indent + "("), k, F.lit(") "), F.try_element_at(options, k))), "\n")


def answer_format(options: Column, kind: Column, w: Wording = Wording()) -> Column:
    """What the answer must look like: by the number of options and whether several may be chosen."""
    keys = keys_sorted(options)
    n = F.size(keys)
    listed = F.array_join(keys, ", ")
    either = F.when(n == 2, F.array_join(keys, " or ")).otherwise(F.concat(F.array_join(F.slice(keys, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", or "), F.try_element_at(keys, F.lit(-1))))
    fill = lambda t, c: F.replace(F.lit(t), F.lit("{options_list}"), c)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, w.open).when(kind == "multi", fill(w.multi, listed)).otherwise(fill(w.single, either))


def messages_of(system: Column, text: Column, options: Column, kind: Column, with_tools: Column, w: Wording = Wording()) -> Column:
    """array of (role, content): the system prompt, with the budget where there are tools, and the question with options and format."""
    head = F.concat(F.regexp_replace(system, r"\s+$", ""), F.when(with_tools, "\n" + w.budget).otherwise(""))
    body = F.concat_ws("\n\n", F.coalesce(text, F.lit("")), F.coalesce(options_lines(options), F.lit("")), answer_format(options, kind, w))
    return F.array(F.struct(F.lit("system").alias("role"), head.alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def correct_text(options: Column, correct: Column, kind: Column) -> Column:
    """The right answer in words; for several each with its letter, NONE for none."""
    of = lambda k: F.coalesce(F.try_element_at(options, k), F.lit("UNKNOWN"))
    several = F.array_join(F.transform(correct, lambda k: F.concat(F.lit("("), k, F.lit(") "), of(k))), ", ")
    return F.when(kind == "multi", F.when(F.size(correct) == 0, "NONE (no correct answers)").otherwise(several)).otherwise(of(F.try_element_at(correct, F.lit(1))))


def judge_prompt(question: Column, response: Column, evaluate: Column, rubric: Column, instructions: Column, w: Wording = Wording()) -> Column:
    """The parts of a judge's prompt joined by blank lines; scores of the rubric fall, keys that are no numbers come last."""
    number = lambda k: F.when(k.rlike("^[0-9]+$"), k.cast("int")).otherwise(F.lit(-1))
    entries = F.array_sort(F.transform(F.map_entries(rubric), lambda e: F.struct((-number(e["key"])).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    lines = F.concat(F.array(F.lit("## Scoring Rubric (0–5)")), F.transform(entries, lambda e: F.concat(F.lit("["), e["k"], F.lit("] "), e["v"])))
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("## Question\n"), F.coalesce(question, F.lit(""))), F.concat(F.lit("## Response to Evaluate\n"), F.when(F.coalesce(response, F.lit("")) == "", "(no response)").otherwise(response)),
        part("What to Evaluate", evaluate), F.when(F.size(rubric) > 0, F.array_join(lines, "\n")), part("Judge Instructions", instructions), F.lit(w.closing),
    )


def message_json(role: Column, content: Column, name: Column, tool_call_id: Column) -> Column:
    """A message as JSON; what is null or empty, but for the content, is left out."""
    some = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(role.alias("role"), F.coalesce(content, F.lit("")).alias("content"), some(name).alias("name"), some(tool_call_id).alias("tool_call_id")))


def api_content(role: Column, content: Column, n_tool_calls: Column) -> Column:
    """Null for an assistant's message that has calls and no words."""
    return F.when((role == "assistant") & (n_tool_calls > 0) & (content == ""), F.lit(None).cast("string")).otherwise(content)


def tool_schema(name: str, description: str, properties: dict, required: list[str]) -> dict:
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": required}}}


def tools(checked_at_once: int = 10) -> list[dict]:
    """Schemas of the three tools: checking names, parents, children."""
    one = {"descriptor": {"type": "string", "description": "a name"}}
    many = {"descriptors": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": checked_at_once}}
    return [
        tool_schema("validate_descriptors", f"Which of at most {checked_at_once} names are nodes of the hierarchy.", many, ["descriptors"]),
        tool_schema("get_parent", "All parents of a node.", one, ["descriptor"]),
        tool_schema("get_children", "All children of a node.", one, ["descriptor"]),
    ]


def with_icl_tools(system: Column, tool_text: str) -> Column:
    """A system prompt with the description of tools that are called in the text."""
    return F.concat(F.regexp_replace(system, r"\s+$", ""), F.lit("\n\n"), stripped(F.lit(tool_text)))
