from __future__ import annotations

import pytest

from trellis.operators import clients, replay


def failing(*errors):
    left = list(errors)

    def client(messages):
        if left:
            raise left.pop(0)
        return {"content": "done"}

    return client


def test_retries():
    waits = []
    again = lambda c: clients.retrying(c, 3, 1.0, waits.append)([])
    assert again(failing(TimeoutError(), clients.Refused(503)))["content"] == "done" and waits == [1.0, 2.0]
    waits.clear()
    assert again(failing(clients.Refused(429, 7.5)))["content"] == "done" and waits == [7.5]
    with pytest.raises(clients.Refused):
        again(failing(clients.Refused(400)))
    with pytest.raises(TimeoutError):
        again(failing(TimeoutError(), TimeoutError(), TimeoutError()))


@pytest.mark.parametrize(("text", "call"), [('TOOL_CALL: {"name": "get_parent", "args": {"descriptor": "x"}} ok', ("get_parent", {"descriptor": "x"})), ('TOOL_CALL: {"name": "a", "args": [1]}', ("a", {})), ('TOOL_CALL: {"name": ""}', None), ("TOOL_CALL: {bad}", None), ("none", None)])
def test_written_calls(text, call):
    assert clients.tool_call_in(text) == call


def test_ask_and_written_loop(spark):
    q = spark.createDataFrame([("1", "p"), ("2", "boom")], "question_id string, prompt string")

    def make():
        def client(messages):
            if messages[0]["content"] == "boom" and len(messages) == 1:
                raise ValueError("no")
            return {"content": "I select (B)", "tokens": 3}

        return client

    got = {r.question_id: r for r in clients.ask(q, make).collect()}
    assert (got["1"].content, got["1"].tokens, got["1"].error) == ("I select (B)", 3, None) and got["2"].error == "ValueError: no"

    def writer():
        def client(messages):
            told = [m for m in messages if m["content"].startswith("TOOL_RESULT")]
            return {"content": "I select (A)" if told else 'TOOL_CALL: {"name": "get_children", "args": {"descriptor": "x"}}', "tokens": 1}

        return clients.writing_calls(client)

    r = replay.run_tool_loop(q.limit(1), writer, lambda n, a: {"children": []}, lambda t: "A" if "(A)" in t else None).first()
    assert (r.answer, r.reasoning_calls, r.total_turns, r.answered_early) == ("A", 1, 2, True)
    assert clients.recorded({"p": "x"})([{"content": "p"}])["content"] == "x"
