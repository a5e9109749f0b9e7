"""Where a bank is found, what of it is loaded, counted and backed up."""

from __future__ import annotations

import datetime
import json

import pytest

from trellis.sources import bank
from trellis.sources.commits import Commits

QUESTIONS = [("A1_1", "A1_root", "A"), ("A1_2", "A1_root", None), ("e1_3", None, "E"), ("F_4", "", "F"), ("x", None, None)]


@pytest.fixture
def made(spark):
    q = spark.createDataFrame(QUESTIONS, "id string, task_type string, category string")
    return q, spark.createDataFrame([("A1_1", "confirmed"), ("e1_3", "confirmed"), ("e1_3", "confirmed"), ("F_4", "flagged"), ("gone", "confirmed")], "question_id string, status string")


def test_default_graph(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bank.default_graph(spark, str(tmp_path))
    (tmp_path / "system_graph_data.pkl").write_bytes(b"")
    with pytest.raises(ValueError, match="json"):
        bank.default_graph(spark, str(tmp_path))
    (tmp_path / "system_graph_data.json").write_text(json.dumps({"root": "R", "descriptions": ["R", "a"], "connections": [["R", "a"]]}))
    h = bank.default_graph(spark, str(tmp_path))
    assert h.root == "R" and h.nodes.count() == 2


def test_some_questions(spark, made):
    q, state = made
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(bank.some_questions(q)) == sorted(x[0] for x in QUESTIONS)
    assert ids(bank.some_questions(q, "A1")) == ["A1_1", "A1_2"] and ids(bank.some_questions(q, "e")) == ["e1_3"]
    assert ids(bank.some_questions(q, None, state)) == ["A1_1", "e1_3"] and ids(bank.some_questions(q, "A", state)) == ["A1_1"]


def test_counts_and_saving(spark, made, tmp_path):
    q, state = made
    got = {(r.what, r.key): r.n for r in bank.counts(q, state).collect()}
    assert got == {("total", ""): 5, ("category", "A"): 1, ("category", ""): 2, ("category", "E"): 1, ("category", "F"): 1, ("task_type", "A1_root"): 2, ("task_type", ""): 3, ("confirmed", "A1"): 1, ("confirmed", "E1"): 1}
    into = Commits(spark, str(tmp_path / "bank"), "id string, task_type string, category string")
    bank.save(q, into, state, now=lambda: datetime.datetime(2024, 5, 1))
    bank.save(q.limit(2), into)
    assert into.log()[0]["meta"]["confirmed:A1"] == "1" and into.log()[0]["meta"]["last_modified"] == "2024-05-01T00:00:00" and into.read().count() == 2 and into.read(1).count() == 5
    assert bank.counts(q.limit(0)).count() == 0


def test_backups(spark, made, tmp_path):
    q, state = made
    into, monday, tuesday = Commits(spark, str(tmp_path / "b"), "id string, task_type string, category string"), datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    none = state.where("question_id = 'A1_1'")
    assert bank.backup(q, none, into, monday) == 1  # the first of the day
    assert bank.backup(q, none, into, monday) is None
    assert bank.backup(q, state, into, monday, incremental=False) is None
    assert bank.backup(q.limit(3), state, into, monday) == 2  # more are confirmed
    assert bank.backup(q, state, into, tuesday) == 3 and bank.backup(q, state, into, tuesday) is None and bank.backup(q, state, into, tuesday, force=True) == 4
    assert bank.backup_of(into, 1).count() == 5 and bank.backup_of(into, 2).count() == 5
    with pytest.raises(FileNotFoundError):
        bank.backup_of(into, 9)
