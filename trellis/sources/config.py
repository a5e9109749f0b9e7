"""Configuration of an evaluation: conditions, models and their prices, question templates; and checks before a run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import validate
from ..operators.hierarchy import WEIGHTS, Hierarchy


@dataclass(frozen=True)
class Condition:
    name: str
    tools_enabled: bool = False
    max_reasoning_calls: int = 5
    system_prompt: str = ""


@dataclass(frozen=True)
class Model:
    id: str
    provider: str = "recorded"
    price_in: float = 0.0
    price_out: float = 0.0
    tool_mode: str = "native"
    enabled: bool = True


@dataclass(frozen=True)
class Template:
    task_type: str
    template: str
    count: int = 0
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    conditions: tuple[Condition, ...] = ()
    models: tuple[Model, ...] = ()
    templates: tuple[Template, ...] = ()

    def model_table(self, spark: SparkSession) -> DataFrame:
        """(model, provider, price_in, price_out) of the enabled models."""
        rows = [(m.id, m.provider, m.price_in, m.price_out) for m in self.models if m.enabled]
        return spark.createDataFrame(rows, "model string, provider string, price_in double, price_out double")

    def matrix(self, spark: SparkSession, questions: DataFrame) -> DataFrame:
        """(question_id, model, condition): every question for every enabled model and condition."""
        pairs = F.array(*(F.struct(F.lit(m.id).alias("model"), F.lit(c.name).alias("condition")) for m in self.models if m.enabled for c in self.conditions))
        return questions.select(F.col("id").alias("question_id"), F.explode(pairs).alias("p")).select("question_id", "p.model", "p.condition")


def from_dict(raw: dict[str, Any]) -> Config:
    """A checked configuration of a nested dict; a wrong type or a missing key names its place."""
    checks.mapping(raw, "config")
    conditions = []
    for name, c in checks.mapping(raw.get("conditions", {}), "conditions").items():
        checks.mapping(c, f"conditions.{name}")
        conditions.append(Condition(
            name, checks.boolean(c.get("tools_enabled", False), f"conditions.{name}.tools_enabled"),
            checks.integer(c.get("max_reasoning_calls", 5), f"conditions.{name}.max_reasoning_calls", 0), checks.string(c.get("system_prompt", ""), f"conditions.{name}.system_prompt"),
        ))
    models = []
    for i, m in enumerate(checks.sequence(raw.get("models", []), "models")):
        checks.mapping(m, f"models[{i}]", ["id"])
        price = checks.mapping(m.get("pricing", {}), f"models[{i}].pricing")
        models.append(Model(
            checks.string(m["id"], f"models[{i}].id"), checks.string(m.get("provider", "recorded"), f"models[{i}].provider"),
            checks.number(price.get("input", 0.0), f"models[{i}].pricing.input", 0), checks.number(price.get("output", 0.0), f"models[{i}].pricing.output", 0),
            checks.string(m.get("tool_mode", "native"), f"models[{i}].tool_mode", ["native", "icl"]), checks.boolean(m.get("enabled", True), f"models[{i}].enabled"),
        ))
    templates = [
        Template(checks.string(k, "templates"), checks.string(t.get("template", ""), f"templates.{k}.template"), checks.integer(t.get("count", 0), f"templates.{k}.count", 0), {x: v for x, v in t.items() if x not in ("template", "count")})
        for k, t in checks.mapping(raw.get("templates", {}), "templates").items()
    ]
    return Config(tuple(conditions), tuple(models), tuple(templates))


def load(path: str) -> Config:
    """A configuration of a JSON file, or of a YAML file where a YAML reader is installed. It lies with the driver."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed; use JSON") from e
        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))


def preflight(config: Config, questions: DataFrame, h: Hierarchy) -> list[str]:
    """What is wrong before a run; empty if nothing is."""
    problems = []
    if not any(m.enabled for m in config.models):
        problems.append("no model is enabled")
    if not config.conditions:
        problems.append("there is no condition")
    r = validate.report(questions.where("kind <> 'open'") if "kind" in questions.columns else questions)
    n = r.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"), (F.count("*") - F.count_distinct("id")).alias("twice")).first()
    if not n.n:
        problems.append("there are no questions")
    if n.bad:
        problems.append(f"{n.bad} questions are not valid")
    if n.twice:
        problems.append(f"{n.twice} questions repeat an id")
    if h.is_dag().first().nodes_left:
        problems.append("the hierarchy has a cycle")
    unknown = h.edges.where(~F.col("path_type").isin(list(WEIGHTS))).select("path_type").distinct().limit(5).collect()
    problems += [f"edges of type {u.path_type!r} have no weight" for u in unknown]
    return problems
