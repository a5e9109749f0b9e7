from __future__ import annotations

import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trellis.operators import generate, nodefilter, ordering, replay, review, summary, validate
from trellis.operators.hierarchy import Hierarchy
from trellis.sources import files
from trellis.sources.snapshots import Snapshots


@pytest.fixture(scope="module")
def small(spark):
    """root -> floral (rose, jasmine), fruity (berry -> (blueberry), citrus); rose also below fruity; one isolated node."""
    names = ["root", "floral", "fruity", "rose", "jasmine", "berry", "citrus", "blueberry", "alone"]
    edges = [("root", "floral"), ("root", "fruity"), ("floral", "rose"), ("floral", "jasmine"), ("fruity", "berry"), ("fruity", "citrus"), ("berry", "blueberry"), ("fruity", "rose")]
    return files.graph_from_rows(spark, names, [{"source": a, "target": b} for a, b in edges], "root")


def as_dict(df, key="name"):
    return {r[key]: r for r in df.collect()}


def test_parents_and_first_parent(small):
    assert as_dict(small.parents())["rose"].parents == ["floral", "fruity"]
    assert as_dict(small.first_parent())["rose"].parent == "floral"


def test_leaves_and_middles(small):
    assert {r.name for r in small.leaves().collect()} == {"rose", "jasmine", "citrus", "blueberry", "alone"}
    assert {r.name for r in small.middles().collect()} == {"floral", "fruity", "berry"}


def test_root_category(small):
    got = {r.name: r.category for r in small.root_category().collect()}
    assert got["blueberry"] == "fruity" and got["floral"] is None and got["alone"] is None
    assert {r.name: r.category for r in small.root_category(strict=True).collect()}["floral"] == "floral"
    assert as_dict(small.root_categories_of_parents()).get("rose") is None  # both parents are root categories


def test_lca_is_symmetric_and_idempotent(spark, small):
    p = spark.createDataFrame([("rose", "jasmine"), ("jasmine", "rose"), ("rose", "rose"), ("blueberry", "rose"), ("berry", "blueberry"), ("alone", "rose")], "a string, b string")
    got = {(r.a, r.b): (r.lca, r.hops) for r in small.lca(p).collect()}
    assert got[("rose", "jasmine")] == got[("jasmine", "rose")] == ("floral", 2)
    assert got[("rose", "rose")] == ("rose", 0) and got[("berry", "blueberry")] == ("berry", 1)
    assert got[("blueberry", "rose")] == ("root", 5) and got[("alone", "rose")] == (None, None)


def test_siblings_and_cousins(small):
    pairs = small.siblings().groupBy("name").agg(F.count("*").alias("n"), F.min("sibling").alias("first"))
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in small.sibling_summary().collect()}
    cousins = small.cousins().groupBy("name").agg(F.count_distinct("cousin").alias("n"))
    assert {tuple(r) for r in cousins.collect()} == {tuple(r) for r in small.cousin_summary().collect()} and cousins.count() > 0


def test_distances(spark, small):
    got = {r.name: r.distance for r in small.distances(spark.createDataFrame([("rose",)], "name string"), max_hops=6).collect()}
    assert got["rose"] == 0 and got["jasmine"] == 2 and got["blueberry"] == 3 and "alone" not in got


def test_paths_end_and_are_simple(spark, small):
    p = spark.createDataFrame([("root", "rose")], "a string, b string")
    got = [r.path for r in small.paths(p, 5).orderBy("rank").collect()]
    assert got[:2] == [["root", "floral", "rose"], ["root", "fruity", "rose"]]
    assert all(len(set(x)) == len(x) for x in got)


def chain_of(spark, n, extra=()):
    names = [f"n{i}" for i in range(n)]
    edges = [{"source": a, "target": b, "path_type": "related"} for a, b in [*zip(names, names[1:], strict=False), *extra]]
    return files.graph_from_rows(spark, names, edges, "n0")


def test_depth_is_not_bounded(spark):
    h = chain_of(spark, 40)
    chain = {}
    for r in h.ancestors().collect():
        chain.setdefault(r.name, []).append((r.dist, r.ancestor))
    assert {k: sorted(v) for k, v in chain.items()} == {f"n{i}": [(d, f"n{i - d}") for d in range(1, i + 1)] for i in range(1, 40)}
    assert {r.name: r.depth for r in h.depth().collect()} == {f"n{i}": i for i in range(40)}
    assert {r.name: r.category for r in h.root_category().collect()}["n39"] == "n1"
    assert h.descendants().count() == 40 * 39 // 2 and h.descendants("n7").count() == 32
    pairs = spark.createDataFrame([("n30", "n12"), ("n39", "n39")], "a string, b string")
    assert {(r.a, r.b): (r.lca, r.hops) for r in h.lca(pairs).collect()} == {("n30", "n12"): ("n12", 18), ("n39", "n39"): ("n39", 0)}
    assert h.is_dag().first().nodes_left == 0
    one = spark.createDataFrame([("n0", "n20")], "a string, b string")
    assert [(len(r.path), r.cost) for r in h.paths(one, 3, weighted=True).collect()] == [(21, 100.0)]


def test_weights_and_unreachable_pairs(spark):
    h = chain_of(spark, 5, [("n0", "n3")])
    pairs = spark.createDataFrame([("n0", "n3"), ("n3", "n0"), ("n0", "n4"), ("n2", "n2"), ("n4", "nobody")], "a string, b string")
    inf = float("inf")
    far = lambda **o: {(r.a, r.b): r.distance for r in h.distance_of(pairs, **o).collect()}
    assert far(weighted=True, reverse=False) == {("n0", "n3"): 5.0, ("n3", "n0"): inf, ("n0", "n4"): 10.0, ("n2", "n2"): 0.0, ("n4", "nobody"): inf}
    assert far(weighted=True)["n3", "n0"] == 5.0 and far()["n0", "n4"] == 2.0
    got = [(r.rank, r.path, r.cost) for r in h.paths(pairs.limit(1), 5, weighted=True, reverse=False).orderBy("rank").collect()]
    assert got == [(1, ["n0", "n3"], 5.0), (2, ["n0", "n1", "n2", "n3"], 15.0)]
    odd = files.graph_from_rows(spark, ["a", "b"], [{"source": "a", "target": "b", "path_type": "unheard"}], "a")
    with pytest.raises(ValueError, match="unheard"):
        odd.distances(spark.createDataFrame([("a",)], "name string"), weighted=True)
    assert odd.distances(spark.createDataFrame([("a",)], "name string")).count() == 2


def test_walks_on_cycles_end(spark):
    h = chain_of(spark, 12, [("n6", "n2")])  # n2 to n6 are a cycle, behind which the others lie
    parent = {r.name: r.parent for r in h.first_parent().collect()}
    want = set()
    for n in [f"n{i}" for i in range(12)]:
        seen, at = [n], parent.get(n)
        while at is not None and at not in seen:
            want.add((n, at, len(seen)))
            seen.append(at)
            at = parent.get(at)
    assert {tuple(r) for r in h.ancestors().select("name", "ancestor", "dist").collect()} == want
    assert h.is_dag().first().nodes_left == 10
    assert ("n4", "n4") in {tuple(r) for r in h.descendants().collect()}
    loop = files.graph_from_rows(spark, ["a", "b", "c"], [{"source": x, "target": y} for x, y in ("ab", "bc", "ca")], "a")
    assert {tuple(r) for r in loop.ancestors().collect()} == {("a", "c", 1), ("a", "b", 2), ("b", "a", 1), ("b", "c", 2), ("c", "b", 1), ("c", "a", 2)}


def test_cycle_is_found_and_walks_end(spark, small):
    assert small.is_dag().first().nodes_left == 0
    loop = small.with_edge("blueberry", "fruity", "related", 99)
    assert loop.is_dag().first().nodes_left > 0
    assert loop.ancestors().count() > 0 and loop.descendants().count() > 0


def test_changes(small):
    assert small.without_node("rose").edges.count() == 6
    assert small.without_edge("rose", "fruity").edges.count() == 7
    with pytest.raises(ValueError, match="path type"):
        small.with_edge("a", "b", "unheard-of", 1)


def test_adjacency(small):
    a = {(r.i, r.j): r.value for r in small.adjacency(reverse=True).collect()}
    assert a[("root", "floral")] == a[("floral", "root")] == 2


def test_connection(spark, small):
    p = spark.createDataFrame([("root", "floral"), ("floral", "root"), ("rose", "citrus")], "a string, b string")
    assert {(r.a, r.b): r.direction for r in small.connection(p).collect()} == {("root", "floral"): "forward", ("floral", "root"): "reverse", ("rose", "citrus"): "X"}


QUESTIONS = [("A1_1", "A1", 1), ("A1_2", "A1", 2), ("A2_1", "A2", 3), ("A1_3", "A1", 4), ("A2_2", "A2", 5), ("A3_1", "A3", 6), ("A2_3", "A2", 7), ("A1_4", "A1", 8), ("A2_4", "A2", 9), ("A3_2", "A3", 10)]
STATE = [("A1_1", "confirmed"), ("A1_2", "confirmed"), ("A1_3", "flagged"), ("A2_1", "confirmed"), ("A2_2", "flagged"), ("A3_1", "confirmed"), ("A2_3", "flagged")]


@pytest.fixture(scope="module")
def queue(spark):
    q = spark.createDataFrame(QUESTIONS, "id string, task_type string, pos long")
    return q, spark.createDataFrame(STATE, "question_id string, status string")


def test_queue_counts(queue):
    got = as_dict(review.queue_stats(*queue), "task_type")
    assert (got["A1"].confirmed, got["A1"].flagged, got["A1"].pending, got["A1"].total) == (2, 1, 1, 4)
    assert (got["A2"].confirmed, got["A2"].flagged, got["A2"].pending, got["A2"].total) == (1, 2, 1, 4)


def test_queue_rules(queue):
    s = review.with_status(*queue)
    open_ = F.col("status") != "confirmed"
    got = ordering.by_rules(s, "pos", [(F.col("task_type") == "A2") & open_, (F.col("task_type") == "A3") & open_, ~open_]).orderBy("new_pos")
    assert [r.id for r in got.collect()] == ["A2_2", "A2_3", "A2_4", "A3_2", "A1_1", "A1_2", "A2_1", "A3_1", "A1_3", "A1_4"]
    assert [r.id for r in ordering.to_front(s, "pos", F.col("task_type") == "A2").orderBy("new_pos").collect()][:2] == ["A2_1", "A2_2"]
    assert [r.id for r in ordering.to_back(s, "pos", F.col("task_type") == "A2").orderBy("new_pos").collect()][-1] == "A2_4"


def test_next_to_review_cycles(spark, queue):
    skip = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert review.next_to_review(*queue, skip()).first().id == "A1_4"
    assert review.next_to_review(*queue, skip("A1_4")).first().id == "A2_4"
    assert review.next_to_review(*queue, skip("A1_4", "A2_4", "A3_2")).first().id == "A1_4"


@pytest.mark.parametrize("n", [1, 3, 7, 10, 12])
def test_stride(spark, n):
    rows = spark.createDataFrame([("g", i) for i in range(10)], "g string, pos long")
    got = sorted(r.pos for r in ordering.stride_sample(rows, "g", "pos", n).collect())
    assert got == (list(range(10)) if n >= 10 else sorted({int(i * 10 / n) for i in range(n)}))


def test_keep_latest_tie_keeps_first(spark):
    rows = spark.createDataFrame([("a", "old", 1, 0), ("a", "new", 1, 1), ("b", "x", 1, 0), ("b", "y", 2, 1)], "k string, v string, ts long, source int")
    assert {r.k: r.v for r in ordering.keep_latest(rows, "k", "ts", "source").collect()} == {"a": "old", "b": "y"}


def test_spaced_levels(spark):
    rows = spark.createDataFrame([("t", f"n{d}", d) for d in (1, 2, 3, 5, 6, 9)], "target string, name string, distance long")
    assert [r.distance for r in ordering.spaced_levels(rows, 3, 2, "s").orderBy("distance").collect()] == [1, 3, 5]


def test_first_occurrence_passes_nulls(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None)], "pos long, v string")
    assert [r.is_duplicate for r in ordering.first_occurrence(rows, "v", "pos").orderBy("pos").collect()] == [False, False, True, False]


def test_macro_ignores_untyped_rows_and_is_no_mean_of_macros(spark):
    rows = [("m1", "no_tool", "T1", 1.0), ("m1", "no_tool", "T1", 0.0), ("m1", "no_tool", "T2", 1.0), ("m2", "no_tool", "T1", 0.0), ("m1", "tool", "", 0.0)]
    df = spark.createDataFrame(rows, "model string, condition string, task_type string, score double")
    assert summary.macro(df, "model", "condition").where("model = 'm1' and condition = 'no_tool'").first().macro_score == 0.75
    assert summary.macro(df.withColumn("all", F.lit(1)), "all").first().macro_score == pytest.approx((1 / 3 + 1) / 2)


def test_filter_reasons_and_whitelist(small):
    c = nodefilter.FilterConfig(excluded_parents=("berry",), whitelist=("floral", "nobody"), blacklist=("citrus",))
    got = as_dict(nodefilter.staged(small.facts(), c))
    assert got["jasmine"].kept and not got["citrus"].kept and got["floral"].kept and not got["blueberry"].kept
    assert got["blueberry"].reasons == ["parent:berry"] and got["alone"].reasons == ["too_shallow"]
    f = nodefilter.funnel(small.facts(), c).first()
    assert (f.total, f.after_structural, f.after_category, f.final, f.rate) == (9, 4, 3, 3, "33.3%")


def test_name_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# none\n\nrose \n tea\nrose\n")
    assert sorted(r.name for r in nodefilter.read_names(spark.read.text(str(tmp_path / "l.txt"))).collect()) == ["rose", "tea"]


def test_validation(spark):
    rows = [("1", "t", "A1", {"A": "x", "B": "y"}, ["A"]), ("2", "t", "A1", {"A": "x", "b": "x"}, ["C"]), ("3", None, "A1", {}, [])]
    got = {r.id: r.errors for r in validate.report(spark.createDataFrame(rows, "id string, text string, task_type string, options map<string,string>, correct array<string>")).collect()}
    assert got["1"] == [] and got["2"] == ["invalid options format", "correct answer not in options", "duplicate options"]
    assert got["3"] == ["missing required fields", "invalid options format"]


def test_text_overlap_rules(spark):
    df = spark.createDataFrame([("A3_x", "green tea", {"A": "Tea leaf"}, None), ("A4_x", "green tea", {"A": "tea"}, None), ("A3_x", "the rose", {"A": "the tea"}, "leaf"), ("A3_x", "rose", {"A": "tea"}, "rose garden")], "t string, d string, o map<string,string>, p string")
    got = [r.x for r in df.select(validate.no_text_overlap(F.col("t"), F.col("d"), F.col("o"), F.col("p")).alias("x")).collect()]
    assert got == [False, True, True, False]


def test_checked_names_stop_at_ten(spark, small):
    calls = spark.createDataFrame([(1, [f"n{i}" for i in range(20)]), (2, ["rose", "no", "berry"])], "call_id long, names array<string>")
    got = {r.call_id: r for r in replay.checked_names(calls, small.nodes).collect()}
    assert len(got[1].invalid) == 10 and got[1].truncated and got[2].valid == ["rose", "berry"] and got[2].invalid == ["no"]


def test_tool_answers(spark, small):
    calls = spark.createDataFrame([(1, "get_parent", "root"), (2, "get_children", "rose"), (3, "get_parent", "nobody"), (4, "get_children", "berry")], "call_id long, tool string, name string")
    got = {r.call_id: r for r in replay.tool_answers(calls, small.parents(), small.children(), small.nodes).collect()}
    assert got[1].result == [] and got[2].result == [] and got[4].result == ["blueberry"]
    assert got[3].result is None and "not found" in got[3].error


def test_assembled_stream(spark):
    rows = [("r", 2, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), ("r", 1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), ("r", 3, "data: {broken"), ("r", 4, 'data: {"choices":[],"usage":{"prompt_tokens":5,"completion_tokens":2}}'), ("r", 5, "data: [DONE]")]
    got = replay.assembled(spark.createDataFrame(rows, "response_id string, seq long, line string")).first()
    assert (got.content, got.input_tokens, got.output_tokens) == ("Hello", 5, 2)


def test_tool_loop(spark):
    def scripted():
        def client(messages):
            asked = sum(m["role"] == "assistant" for m in messages)
            if messages[0]["content"] == "early" or asked >= 3:
                return {"content": "I select (B)", "tokens": 10}
            name = "get_parent" if messages[0]["content"] == "budget" else "validate_descriptors"
            return {"content": "", "tool_calls": [(name, {"descriptors": ["x"]})], "tokens": 10}

        return client

    q = spark.createDataFrame([("1", "early"), ("2", "budget"), ("3", "loop")], "question_id string, prompt string")
    got = {r.question_id: r for r in replay.run_tool_loop(q, scripted, lambda n, a: {}, lambda t: "B" if "(B)" in t else None, budget=3).collect()}
    assert (got["1"].total_turns, got["1"].answered_early) == (1, True)
    assert (got["2"].total_turns, got["2"].reasoning_calls, got["2"].answered_early, got["2"].total_tokens) == (4, 3, False, 40)
    assert (got["3"].validation_calls, got["3"].answer) == (3, "B")


def test_generated_questions_hold_their_predicates(spark):
    edges = [("ROOT", r) for r in ("kiwi", "mint", "smoke")]
    edges += [(r, f"{r}{m}") for r in ("kiwi", "mint", "smoke") for m in ("ash", "elm", "oak", "yew")]
    leaf = lambda r, m, c: {"kiwi": f"{c}x{m}q", "mint": f"{c}z{m}w", "smoke": f"{c}v{m}k"}[r]
    edges += [(f"{r}{m}", leaf(r, m, c)) for r in ("kiwi", "mint", "smoke") for m in ("ash", "elm", "oak", "yew") for c in ("bo", "cu", "dy", "ef")]
    every = ["ROOT", *dict.fromkeys(t for _, t in edges)]
    h = files.graph_from_rows(spark, every, [{"source": a, "target": b} for a, b in edges], "ROOT")
    parent = {t: s for s, t in edges}
    bank = generate.bank(h, "s1")
    letters = lambda r: [r.options[ord(x) - 65] for x in r.correct.split(",") if x]
    a3 = bank["A3"].collect()
    assert len(a3) == 48
    for r in a3:
        assert parent[letters(r)[0]] == parent[r.name] and len(set(r.options)) == 4
        assert sum(parent[o] == parent[r.name] for o in r.options) == 1
    for r in bank["E3"].collect():
        odd = letters(r)[0]
        assert parent[parent[odd]] != parent[parent[r.name]] and len({parent[o] for o in r.options if o != odd}) == 1
    a2 = bank["A2"].collect()
    assert {letters(r)[0] for r in a2} == {"Yes", "No"}
    for r in a2:
        claimed = r.text.split("'")[1]
        assert (letters(r)[0] == "Yes") == (claimed in (parent[r.name], parent[parent[r.name]]))
    for r in bank["A4M"].collect():
        right = set(letters(r))
        for o in r.options:
            top, mid, end = o.split(" > ")
            assert (o in right) == (parent[end] == mid and parent[mid] == top)
    assert generate.limited(bank["A1"], 5, "s").count() == 5
    with pytest.raises(ValueError, match="task type"):
        generate.of_type(h, "Z9_x", "s")


def test_questions_of_uneven_depth(spark):
    """Leaves at depth 1, 2, 3 and 5: each has its picks, paths are whole, and common ancestors reach up to the root."""
    edges = [("R", c) for c in ("aa", "bb", "cc", "dd")]
    for c in ("aa", "bb", "cc"):
        edges += [(c, f"{c}{m}") for m in range(4)]
        edges += [(f"{c}{m}", f"{c}{m}x{k}") for m in range(3) for k in range(4)]
        edges += [(f"{c}0x{k}", f"{c}0x{k}y{j}") for k in range(3) for j in range(3)]
        edges += [(f"{c}0x0y{j}", f"{c}0x0y{j}z{i}") for j in range(3) for i in range(3)]
    names = ["R", *dict.fromkeys(t for _, t in edges)]
    h = files.graph_from_rows(spark, names, [{"source": a, "target": b} for a, b in edges], "R")
    parent = {t: s for s, t in edges}

    def path(n):
        return [*path(parent[n]), n] if parent.get(n, "R") != "R" else [n]

    leaves = {n for n in names if n not in {s for s, _ in edges}}
    p = {r.name: r for r in generate.picks(h, "s").collect()}
    assert set(p) == leaves and all(r.path == path(n) and r.top == path(n)[0] for n, r in p.items())
    assert {len(r.path) for r in p.values()} == {1, 2, 3, 4, 5}
    bank = generate.bank(h, "s")
    letters = lambda r: [r.options[ord(x) - 65] for x in r.correct.split(",") if x]
    depths = set()
    for r in bank["A4"].collect():
        assert letters(r) == [" → ".join(path(r.name))] and len(r.options) == 4
        depths.add(len(path(r.name)))
    assert depths >= {2, 3, 4, 5}
    counts = set()
    for r in bank["A5M"].collect():
        a, b = r.text.split("'")[1::2]
        common = {"R", *path(a)[:-1]} & {"R", *path(b)[:-1]}
        assert set(letters(r)) == common & set(r.options) and len(r.options) == 5
        counts.add(len(letters(r)))
    assert max(counts) >= 3
    for r in bank["A4M"].collect():
        assert {o for o in r.options if o.split(" > ") == path(o.split(" > ")[-1])} == set(letters(r))
    for r in bank["A5"].collect():
        a, b = r.text.split("'")[1::2]
        both = [x for x in ["R", *path(a)] if x in ["R", *path(b)]]
        assert letters(r) == [both[-1]]


def test_graph_files(spark, tmp_path):
    doc = {"graph_name": "g", "root": "r", "descriptions": ["r", "a", "b"], "connections": [{"source": "r", "target": "a", "path_type": "related"}, ["a", "b"]]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    h = files.read_graph(spark, str(tmp_path / "g.json"))
    assert h.root == "r" and [(r.source, r.target, r.path_type) for r in h.edges.orderBy("eid").collect()] == [("r", "a", "related"), ("a", "b", "sub-category")]
    with pytest.raises(ValueError, match="json"):
        files.read_graph(spark, "g.pkl")


@pytest.mark.parametrize("wrapped", [True, False])
def test_question_files(spark, tmp_path, wrapped):
    qs = [{"id": "1", "task_type": "A1", "text": "t", "options": {"A": "x"}, "correct_answer": ["A"]}, {"id": "2", "correct_answer": "B", "status": "rejected"}, {"id": "3", "correct_answer": "B"}, {"id": "4", "correct_answer": None}]
    (tmp_path / "q.json").write_text(json.dumps({"metadata": {}, "questions": qs} if wrapped else qs))
    got = {r.id: (r.correct, r.kind) for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"1": (["A"], "multi"), "3": (["B"], "single"), "4": (None, "open")}


def test_audit_and_cache_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"q1": {"status": "confirmed", "timestamp": "2025-01-02T03:04:05"}, "q2": {"status": "flagged", "timestamp": "never", "flag_reason": "r"}}))
    got = {r.question_id: r for r in files.read_audit(spark, str(tmp_path / "a.json")).collect()}
    assert got["q1"].ts is not None and got["q2"].ts is None and got["q2"].flag_reason == "r"
    d = tmp_path / "run" / "org" / "model" / "tool"
    d.mkdir(parents=True)
    (d / "F_1.json").write_text('{"score": 0.5, "metrics": {"total_tokens": 3}}')
    (d / "F_2.json").write_text('{"score": ')
    r = files.read_result_cache(spark, str(tmp_path / "run")).collect()
    assert [(x.model, x.condition, x.question_id, x.metrics.total_tokens) for x in r] == [("org/model", "tool", "F_1", 3)]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), keep=2)
    df = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "k int, v string")
    with pytest.raises(FileNotFoundError):
        s.read()
    for v in ("a", "b", "c"):
        s.write(df(v))
    assert s.versions() == [2, 3] and s.read().first().v == "c"
    s.restore(2)
    assert s.read().first().v == "b"
    s.upsert(spark.createDataFrame([(0, "z"), (5, "n")], "k int, v string"), "k")
    assert {r.k: r.v for r in s.read().collect()} == {0: "z", 5: "n"}


def test_streams(spark, tmp_path):
    from trellis.streaming import incremental

    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    schema = "question_id string, model string, condition string, task_type string, status string, score double, is_correct boolean, judge_score int, total_tokens long, latency_ms long, mtime timestamp, pos long"
    row = {"question_id": "1", "model": "m", "condition": "tool", "task_type": "T", "status": "success", "score": 0.0, "is_correct": False, "total_tokens": 5, "latency_ms": 7, "mtime": "2025-01-01T00:00:00", "pos": 1}
    merged, board = Snapshots(spark, str(tmp_path / "merged")), Snapshots(spark, str(tmp_path / "board"))

    def run():
        q = incremental.keep_summary(incremental.read_new_files(spark, str(src), schema), board, ck, merged)
        q.awaitTermination(120)

    (src / "1.json").write_text(json.dumps(row))
    run()
    (src / "2.json").write_text(json.dumps(row | {"score": 1.0, "is_correct": True, "mtime": "2025-01-02T00:00:00"}) + "\n" + json.dumps(row | {"question_id": "2", "score": 1.0}))
    run()
    total = board.read().where("grouping = 7").first()
    assert (total.n, total.avg_score) == (2, 1.0)

    bank, q_in = Snapshots(spark, str(tmp_path / "bank")), tmp_path / "q"
    q_in.mkdir()
    (q_in / "1.json").write_text('{"id": "a"}\n{"id": "a"}\n{"id": "b"}')
    incremental.append_once(incremental.read_new_files(spark, str(q_in), "id string"), bank, ck + "2").awaitTermination(120)
    (q_in / "2.json").write_text('{"id": "b"}\n{"id": "c"}')
    incremental.append_once(incremental.read_new_files(spark, str(q_in), "id string"), bank, ck + "2").awaitTermination(120)
    assert sorted(r.id for r in bank.read().collect()) == ["a", "b", "c"]


def _left_by_hand(nodes, edges):
    """Nodes that stay when those without parents among the rest are taken away again and again."""
    left = set(nodes)
    while gone := {n for n in left if not any(t == n and s in left for s, t in edges)}:
        left -= gone
    return len(left)


def test_dag_test_on_all_kinds_of_graphs(spark):
    rng = random.Random(8)
    for k in range(4):
        n = rng.randint(8, 30)
        nodes = [f"n{i}" for i in range(n)]
        edges = set()
        for _ in range(rng.randint(0, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            edges.add((nodes[min(a, b)], nodes[max(a, b)]) if k % 3 and a != b else (nodes[a], nodes[b]))
        edges |= {("elsewhere", nodes[0]), (nodes[0], "nowhere")} if k % 2 else set()
        h = Hierarchy(spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "name string, ord long"), spark.createDataFrame([(s, t, "related", i) for i, (s, t) in enumerate(sorted(edges))], "source string, target string, path_type string, eid long"), nodes[0])
        assert h.is_dag().first().nodes_left == _left_by_hand(nodes, edges), sorted(edges)


def test_long_chain(spark):
    """A thousand nodes in a row: rounds go by the logarithm of the depth, and few tables stay."""
    import time

    top = Path((spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).removeprefix("file:"))
    tables = lambda: {x for x in top.iterdir() if x.name.startswith("trellis-") and any(x.iterdir())} if top.is_dir() else set()
    there, n = tables(), 1000
    nodes = spark.range(n).selectExpr("concat('c', id) as name", "id as ord")
    edges = spark.range(n - 1).selectExpr("concat('c', id) as source", "concat('c', id + 1) as target", "if(id % 2 = 0, 'related', 'sub-category') as path_type", "id as eid")
    h = Hierarchy(nodes, edges, "c0")
    began = time.monotonic()
    assert h.is_dag().first().nodes_left == 0
    far = {r.name: r.distance for r in h.distances(nodes.where("name = 'c500'")).collect()}
    took = time.monotonic() - began
    heavy = {r.name: r.distance for r in h.distances(nodes.where("name = 'c500'"), weighted=True, reverse=False).collect()}
    near = {r.name for r in h.distances(nodes.where("name = 'c500'"), weighted=True, max_hops=2).collect()}
    assert far == {f"c{i}": float(abs(i - 500)) for i in range(n)} and near == {"c498", "c499", "c500", "c501", "c502"}
    assert len(heavy) == 500 and heavy["c502"] == 6.0 and heavy["c999"] == 249 * 6 + 5.0
    assert took < 60 and len(tables() - there) <= 5


def test_distances_of_a_forest_are_those_of_rounds(spark):
    rng = random.Random(9)
    names = [f"t{i}" for i in range(40)]
    kinds = ["sub-category", "related", "synonym"]
    edges = [(names[rng.randrange(i)], names[i], rng.choice(kinds), i) for i in range(1, 40) if i % 13]
    h = Hierarchy(spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, ord long"), spark.createDataFrame(edges, "source string, target string, path_type string, eid long"), "t0")
    rounds = Hierarchy(h.nodes, h.edges, "t0")
    rounds._forest = False
    some = spark.createDataFrame([("t3",), ("t20",), ("t39",), ("not there",), ("t3",)], "name string")
    assert h.is_forest()
    for weighted, reverse, most in ((False, False, None), (False, True, 2), (True, True, None), (True, False, 2)):
        got, want = (sorted(tuple(r) for r in x.distances(some, weighted, reverse, most).collect()) for x in (h, rounds))
        assert got == want, (weighted, reverse, most)


def test_nodes_that_share_a_name_count_once(spark):
    nodes = [("root", 0), ("a", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 5)]
    edges = [("root", "a", "sub-category", 1), ("a", "x", "related", 2), ("a", "x", "related", 3), ("a", "x", "sub-category", 4), ("x", "y", "related", 5)]
    h = Hierarchy(spark.createDataFrame(nodes, "name string, ord long"), spark.createDataFrame(edges, "source string, target string, path_type string, eid long"), "root")
    pairs = spark.createDataFrame([("root", "x"), ("root", "y"), ("x", "root")], "a string, b string")
    assert h.is_forest()
    got = {(r.a, r.b, r.distance) for r in h.distance_of(pairs, weighted=True, reverse=False).collect()}
    assert got == {("root", "x", 2.0), ("root", "y", 7.0), ("x", "root", float("inf"))}
    assert h.chain_with_self().groupBy("name", "ancestor").count().where("count > 1").isEmpty()


def test_children_that_share_a_name_are_answered_once_for_each_edge(spark):
    nodes = [("a", 0), ("x", 1), ("y", 2), ("x", 3), ("x", 4)]
    edges = [("a", "x", "related", 1), ("a", "y", "related", 2), ("a", "x", "related", 3), ("a", "x", "related", 4)]
    h = Hierarchy(spark.createDataFrame(nodes, "name string, ord long"), spark.createDataFrame(edges, "source string, target string, path_type string, eid long"), "a")
    calls = spark.createDataFrame([(1, "get_children", "a"), (2, "get_parent", "y"), (3, "get_children", "y"), (4, "get_children", "b"), (5, "fly", "a")], "call_id int, tool string, name string")
    got = {r.call_id: (r.result, r.error) for r in replay.tool_answers(calls, h.parents(), h.children_by_edge(), h.nodes, ",").collect()}
    assert got == {1: ("x,y,x,x", None), 2: ("a", None), 3: ("", None), 4: (None, "'b' not found"), 5: ("", "unknown tool: fly")}


def test_parents_and_children_of_some_names_are_those_of_all(spark):
    nodes = [("a", 0), ("b", 1), ("x", 2), ("y", 3), ("x", 4), ("z", 5), ("a", 6)]
    edges = [("a", "x", "related", 1), ("b", "x", "related", 2), ("a", "y", "related", 3), ("a", "x", "related", 4), ("x", "z", "related", 5)]
    h = Hierarchy(spark.createDataFrame(nodes, "name string, ord long"), spark.createDataFrame(edges, "source string, target string, path_type string, eid long"), "a")
    some = spark.createDataFrame([("x",), ("a",), ("nobody",), (None,)], "name string")
    for all_, of, names in ((h.parents(), h.parents(some), {"x"}), (h.children_by_edge(), h.children_by_edge(some), {"x", "a"})):
        want = {r.name: tuple(r[1]) for r in all_.collect() if r.name in names}
        got = [(r.name, tuple(r[1])) for r in of.collect()]
        assert len(got) == len(want) and dict(got) == want and set(want) == names
    assert [(r.name, r.parents) for r in h.parents(some).collect()] == [("x", ["a", "a", "b"])]
