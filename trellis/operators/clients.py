"""Clients of models: what the tool loop and single questions call. None of them opens a connection by itself.

A client takes messages and gives {content, tool_calls, tokens}. Wrappers add retries, tool calls written in the
text, and recorded answers. They are made on the executors, once for each task.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import TOOL_CALL
from ..shipping import shipped
from .replay import Client


class Refused(Exception):
    """An answer of a service with a status code; ``wait`` is how long it asks to wait, in seconds."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


def retrying(client: Client, attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Client:
    """Tries again after time-outs, status 429 (for as long as it asks) and 500 and above, with doubled pauses; others go through at once."""

    def call(messages: list[dict]) -> dict:
        for k in range(attempts):
            try:
                return client(messages)
            except TimeoutError:
                if k + 1 == attempts:
                    raise
                sleep(pause * 2**k)
            except Refused as e:
                if k + 1 == attempts or (e.status != 429 and e.status < 500):
                    raise
                sleep(e.wait if e.status == 429 and e.wait is not None else pause * 2**k)
        raise AssertionError("no attempt was made")

    return call


def tool_call_in(content: str) -> tuple[str, dict] | None:
    """The first tool call written in a text; arguments that are no object count as none given."""
    found = re.search(TOOL_CALL, content or "")
    if not found:
        return None
    try:
        raw = json.loads(found[1])
    except ValueError:
        return None
    name, args = raw.get("name"), raw.get("args", {})
    return (name, args if isinstance(args, dict) else {}) if isinstance(name, str) and name else None


def writing_calls(client: Client) -> Client:
    """A client whose model writes its tool calls into the text."""

    def call(messages: list[dict]) -> dict:
        reply = client([m if m.get("role") != "tool" else {"role": "user", "content": "TOOL_RESULT: " + m["content"]} for m in messages])
        found = tool_call_in(reply.get("content", ""))
        return reply | ({"tool_calls": [found]} if found else {})

    return call


def recorded(answers: dict[str, str]) -> Client:
    """Answers by the content of the first message; for tests and replays of a bounded set."""
    return lambda messages: {"content": answers.get(messages[0]["content"], ""), "tokens": 0}


def ask(prompts: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """(question_id, content, tokens, error): one turn for each row (question_id, prompt); a failure is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in frames:
            rows = []
            for qid, prompt in zip(pdf.question_id, pdf.prompt, strict=True):
                try:
                    r = client([{"role": "user", "content": prompt}])
                    rows.append((qid, r.get("content", ""), int(r.get("tokens", 0)), None))
                except Exception as e:  # noqa: BLE001  any failure of a client is data here
                    rows.append((qid, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["question_id", "content", "tokens", "error"])

    shipped(prompts.sparkSession)
    return prompts.select("question_id", "prompt").mapInPandas(run, "question_id string, content string, tokens long, error string")
