"""Places, drawing under caps, used keys and questions with several right answers, against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trellis.functions import text
from trellis.operators import drawing, generate, multi, places
from trellis.operators.hierarchy import Hierarchy

SEED = "s"


def number(key, seed=SEED):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:15], 16)


def past(x, taken):
    for y in sorted(taken):
        if x >= y:
            x += 1
    return x


def draw_by_hand(ranges, without, k, key):
    """Numbers over what the ranges hold, past what is taken."""
    every = [s + i for s, n in ranges for i in range(n)]
    taken = sorted({every.index(p) for p in without if p in every})
    left, got = len(every) - len(taken), []
    for j in range(max(0, min(k, left))):
        x = past(number(f"{key}|{j}") % (left - j), taken)
        taken.append(x)
        got.append(every[x])
    return got


@pytest.fixture(scope="module")
def wheel(spark):
    """A forest below ROOT, uneven in width and depth, an isolated node and a cycle beside it."""
    rng = random.Random(4)
    parent, names = {}, ["ROOT"]
    for k in range(150):
        up = rng.choice(names[: 1 + k // 2]) if k > 5 else "ROOT"
        name = f"n{rng.randint(0, 10**6):06d}"
        parent[name] = up
        names.append(name)
    nodes = [(n, i) for i, n in enumerate([*names, "alone", "x", "y", "below"])]
    edges = [(p, n, "sub-category", i) for i, (n, p) in enumerate(parent.items())] + [("x", "y", "sub-category", 900), ("y", "x", "sub-category", 901), ("y", "below", "sub-category", 902)]
    h = Hierarchy(spark.createDataFrame(nodes, "name string, ord long"), spark.createDataFrame(edges, "source string, target string, path_type string, eid long"), "ROOT")
    return h, parent


def path_of(n, parent):
    out = [n]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out[::-1]


def test_drawn(spark):
    rng, rows = random.Random(1), []
    for k in range(120):
        at, ranges = 0, []
        for _ in range(rng.randint(0, 4)):
            at += rng.randint(0, 5)
            n = rng.randint(0, 6)
            ranges.append((at, n))
            at += n
        rows.append((f"k{k}", [(s, n) for s, n in ranges if n], [rng.randint(0, 25) for _ in range(rng.randint(0, 8))], rng.randint(-1, 9)))
    df = spark.createDataFrame(rows, f"key string, of {places.RANGES}, without array<bigint>, k int")
    got = {r.key: r.got for r in df.select("key", places.drawn("of", "without", "k", SEED, "key").alias("got")).collect()}
    for key, of, without, k in rows:
        assert got[key] == draw_by_hand(of, without, k, key), key
    # every place is as likely as another
    many = spark.range(6000).withColumns({"of": places.ranges((F.lit(10), F.lit(3)), (F.lit(20), F.lit(None)), (F.lit(30), F.lit(2))), "without": F.expr("array(11L)")})
    n = Counter(tuple(sorted(r.got)) for r in many.select(places.drawn("of", "without", "2", SEED, "id").alias("got")).collect())
    assert len(n) == 6 and all(850 < c < 1150 for c in n.values())


def test_pairs_are_counted_exactly(spark):
    rng = random.Random(2)
    rs = [*range(60), *(rng.randrange(2**60) for _ in range(300)), *(j * (j - 1) // 2 + d for j in (10**9, 1234567891, 2**30) for d in (-1, 0, 1))]
    i, j = places.pair_of("r")
    for r in spark.createDataFrame([(r,) for r in rs], "r long").select("r", F.expr(i).alias("i"), F.expr(j).alias("j")).collect():
        assert 0 <= r.i < r.j and r.j * (r.j - 1) // 2 + r.i == r.r


def test_preorder_and_family(wheel):
    h, parent = wheel
    order = {r.name: r for r in places.preorder(h).collect()}
    want = sorted((path_of(n, parent) for n in [*parent, "ROOT"]))
    assert [order[p[-1]].pre for p in want] == list(range(1, len(want) + 1)) and len(order) == len(want)
    for n, r in order.items():
        assert r.path == path_of(n, parent) and r.depth == len(r.path) - 1 and r.n == sum(n in path_of(x, parent)[:-1] for x in parent)
    fam = {r.name: r for r in places.family(h).collect()}
    up = parent | {"x": "y", "y": "x", "below": "y"}
    assert set(fam) == set(up) and sorted(r.at for r in fam.values()) == list(range(1, len(up) + 1))
    for n, r in fam.items():
        assert sorted(x.at for x in fam.values() if x.parent == r.parent) == list(range(r.s_start, r.s_start + r.s_n))
        if (g := up.get(up[n])) is not None:
            assert sorted(x.at for x in fam.values() if x.grand == g) == list(range(r.c_start, r.c_start + r.c_n))
            assert r.u_at == fam[r.parent].at and sorted(x.at for x in fam.values() if x.parent == g) == list(range(r.u_start, r.u_start + r.u_n))
        else:
            assert r.grand is None and r.u_at is None and r.c_n is None


@pytest.mark.parametrize("count", [3, 12])
def test_non_siblings_fall_back(wheel, count):
    h, parent = wheel
    fam = places.family(h)
    got = defaultdict(list)
    for r in places.non_siblings(fam.where("name like 'n%'"), fam, count, SEED).orderBy("k").collect():
        got[r.name].append((r.tier, r.other))
    every = [r.name for r in fam.collect()]
    fell = Counter()
    for n, p in parent.items():
        g = parent.get(p)
        cousins = {x for x in every if g is not None and parent.get(x) != p and parent.get(parent.get(x)) == g and x in parent}
        uncles = {x for x in parent if g is not None and parent[x] == g and x != p}
        strangers = {x for x in every if parent.get(x) != p and x != p}
        tiers = defaultdict(set)
        for t, o in got[n]:
            tiers[t].add(o)
        assert len(got[n]) == len({o for _, o in got[n]}) == count  # nobody is lost
        assert tiers["cousin"] <= cousins and len(tiers["cousin"]) == min(count, len(cousins))
        assert tiers["uncle"] <= uncles and len(tiers["uncle"]) == min(count - len(tiers["cousin"]), len(uncles))
        assert tiers["unrelated"] <= strangers - tiers["cousin"] - tiers["uncle"]
        fell.update(t for t, _ in got[n])
    assert all(fell[t] for t in places.TIERS)


def test_non_siblings_of_a_small_tree(spark):
    h = Hierarchy(spark.createDataFrame([("R", 0), ("a", 1), ("b", 2), ("c", 3)], "name string, ord long"), spark.createDataFrame([("R", "a", "t", 1), ("R", "b", "t", 2), ("a", "c", "t", 3)], "source string, target string, path_type string, eid long"), "R")
    fam = places.family(h)
    got = {(r.name, r.tier, r.other) for r in places.non_siblings(fam, fam, 3, SEED).collect()}
    assert got == {("a", "unrelated", "c"), ("b", "unrelated", "c"), ("c", "uncle", "b")}
    empty = Hierarchy(h.nodes.limit(0), h.edges.limit(0), "R")
    fam = places.family(empty)
    assert places.non_siblings(fam, fam, 3, SEED).count() == 0 and places.preorder(empty).count() == 0


def test_a3_for_every_node_with_a_sibling(wheel):
    h, parent = wheel
    rows = generate.a3_tiers(places.family(h), SEED).where("name like 'n%'").collect()
    many = Counter(parent.values())
    assert {r.name for r in rows} == {n for n, p in parent.items() if many[p] > 1}
    for r in rows:
        right = r.options[ord(r.correct) - 65]
        assert len(set(r.options)) == 4 and r.name not in r.options and [o for o in r.options if parent.get(o) == parent[r.name]] == [right]


def test_deep_pairs(wheel):
    h, parent = wheel
    order = places.preorder(h)
    got = defaultdict(list)
    for r in places.deep_pairs(h, order, 4, SEED).orderBy("k").collect():
        got[r.node].append((r.a, r.b))
    for n in parent:
        below = sorted(path_of(x, parent) for x in parent if n in path_of(x, parent)[:-1])
        if len(path_of(n, parent)) < 3 or len(below) < 2:
            assert n not in got
            continue
        pairs = [(below[i][-1], below[j][-1]) for j in range(len(below)) for i in range(j)]
        assert got[n] == [pairs[r] for r in draw_by_hand([(0, len(pairs))], [], 4, f"pair|{n}")]
    assert any(len(v) == 4 for v in got.values()) and any(len(v) < 4 for v in got.values())


def capped_by_hand(draws, kinds, most, used, excluded):
    """Rounds of hash numbers, in lists."""
    room = {n: most - used[n] for _, n in kinds if n not in excluded}
    wait, free = {i: (t, k) for i, t, k in draws}, {(t, k): sorted({n for kk, n in kinds if kk == k and room.get(n, 0) > 0}) for _, t, k in draws}
    out, turn = {}, 0
    while wait:
        at = {}
        for task in set(wait.values()):
            pool = sorted(free[task], key=lambda n: (number(f"{turn}|{task[0]}|{n}"), n))
            asked = sorted((number(f"first|{turn}|{i}"), i) for i, t in wait.items() if t == task)
            for x, n in zip(asked, pool, strict=False):
                at.setdefault(n, []).append((*x, task[0]))
        if not at:
            break
        for n, xs in at.items():
            for _, i, t in sorted(xs)[: room[n]]:
                out[i] = (t, n, turn)
        for i, (t, n, r) in out.items():
            if r == turn:
                room[n] -= 1
                free[wait[i]] = [m for m in free[wait[i]] if m != n]
                del wait[i]
        free = {x: [m for m in pool if room[m] > 0] for x, pool in free.items()}
        turn += 1
    return out


def test_capped_draws(spark, wheel):
    h, parent = wheel
    kinds = drawing.pools(h)
    listed = [(r.kind, r.name) for r in kinds.collect()]
    assert {k for k, _ in listed} == {"leaf", "middle", "any"} and "ROOT" not in {n for _, n in listed}
    used, excluded = Counter({n: i % 4 for i, n in enumerate(sorted(parent)) if i % 3 == 0}), set(sorted(parent)[5:25])
    for per_task in (20, 400):  # plenty of room; more draws than there is room for
        draws = [(f"{t}{i}", t, k) for t, k in drawing.KINDS.items() for i in range(per_task)]
        df = spark.createDataFrame([*draws, (None, "A1", "leaf"), draws[0]], "id string, task string, kind string").withColumn("name", F.lit("clash"))
        u = spark.createDataFrame([(n,) for n, c in used.items() for _ in range(c)], "name string")
        got = {r.id: (r.task, r.name, r.round) for r in drawing.capped(df, kinds, 3, SEED, u, spark.createDataFrame([(n,) for n in excluded], "name string")).collect()}
        assert got == capped_by_hand(draws, listed, 3, used, excluded)
        uses = Counter(n for _, n, _ in got.values()) + used
        assert max(uses.values()) <= 3 and not excluded & {n for _, n, _ in got.values()}
        assert len({(t, n) for t, n, _ in got.values()}) == len(got)
        middles = {n for k, n in listed if k == "middle"}
        assert {t for t, n, _ in got.values() if n in middles} >= {"A3", "E3"} and all(n in middles for t, n, _ in got.values() if t in ("A3", "E3"))
        assert (len(got) == len(draws)) == (per_task == 20)
    assert drawing.capped(df.limit(0), kinds, 3, SEED).count() == 0 and drawing.capped(df, kinds.limit(0), 3, SEED).count() == 0


def test_shared_out(spark):
    requests = [(f"q{i}", "big" if i % 3 else f"g{i % 5}") for i in range(300)] + [("odd", "nobody")]
    members = [("big", f"b{i}") for i in range(250)] + [(f"g{g}", f"m{g}{i}") for g in range(5) for i in range(10)] + [("big", "b0")]
    got = {r.id: (r.group, r.name) for r in drawing.shared_out(spark.createDataFrame(requests, "id string, group string"), spark.createDataFrame(members, "group string, name string"), SEED).collect()}
    assert set(got) == {i for i, _ in requests} and got["odd"] == ("nobody", None)
    given = [x for x in got.values() if x[1] is not None]
    assert len(given) == len(set(given)) and set(given) <= set(members)
    asked, has = Counter(g for _, g in requests), Counter(g for g, _ in set(members))
    assert Counter(g for g, _ in given) == {g: min(n, has[g]) for g, n in asked.items() if has[g]}


def test_used_keys(spark):
    schema = "id long, task string, status string, target string, candidates array<string>, parent string"
    earlier = [
        (1, "E1", "flagged", "t1", ["a", "b", "c"], None), (2, "E2", "pending", "t2", ["x", "y"], None), (3, "F", None, "t3", None, None), (4, "E3", "confirmed", None, None, "p1"),
        (5, "E3", "flagged", None, None, "p2"), (6, "A1", "confirmed", "t4", ["q"], "p3"), (7, "E1", "flagged", "", ["a", None], None), (8, "E2", "x", None, ["1:a", "b"], None),
    ]
    new = [
        (10, "E1", None, "n", ["c", "a", "b"], None), (11, "E1", None, "n", ["a", "b", "d"], None), (12, "E2", None, "t1", ["u", "v"], None), (13, "E2", None, "n", ["y", "x"], None), (14, "F", None, "t2", None, None),
        (15, "E3", None, None, None, "p1"), (16, "E3", None, None, None, "p2"), (17, "A1", None, "t1", ["a", "b", "c"], "p1"), (18, "E2", None, "n", ["a", "b"], None), (19, "F", None, "t4", None, None), (20, None, None, None, None, None),
        (21, "E1", None, "n", ["x", "y"], None), (22, "E2", None, "n", ["a", "1:b"], None),
    ]
    e, n = spark.createDataFrame(earlier, schema), spark.createDataFrame(new, schema)
    assert sorted(r.id for r in drawing.without_used(n, e).collect()) == [11, 16, 17, 18, 19, 20, 21, 22]
    assert sorted(r.id for r in drawing.without_used(n, e, ("E1 order",)).collect()) == [r[0] for r in new]  # the same three in another order
    assert [r.id for r in drawing.without_used(e.where("id = 1"), e, ("E1 order",)).collect()] == []
    assert drawing.without_used(n, e.limit(0)).count() == len(new) and drawing.without_used(n.limit(0), e).count() == 0


def test_the_filter_misses_nothing(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    rows = spark.range(140_000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = drawing.perhaps_in(rows, keys)
    assert got.join(keys, "key", "left_semi").count() == 20_000 and got.count() < 20_000 + 0.05 * 120_000


def test_paths_of_different_roots(spark):
    edges, leaves = [], {}
    for r in range(7):
        root = "defected" if r == 0 else f"r{r}"
        edges.append(("ROOT", root))
        for m in range(1 + r):
            edges.append((root, f"{root}m{m}"))
            for i in range(30 if r == 3 else 8):
                up = f"{root}m{m}"
                if i % 3 == 0:
                    edges.append((up, f"{up}x{i}"))
                    up = f"{up}x{i}"
                edges.append((up, f"{up}l{i}"))
                leaves[f"{up}l{i}"] = [root, *([f"{root}m{m}"] if i % 3 else [f"{root}m{m}", up]), f"{up}l{i}"]
    edges.append(("ROOT", "bare"))
    nodes = [("ROOT", 0), *((t, i + 1) for i, (_, t) in enumerate(edges))]
    h = Hierarchy(spark.createDataFrame(nodes, "name string, ord long"), spark.createDataFrame([(s, t, "t", i) for i, (s, t) in enumerate(edges)], "source string, target string, path_type string, eid long"), "ROOT")
    order = places.preorder(h)
    used = spark.createDataFrame([(n,) for n in sorted(leaves)[-20:]], "name string")
    got = defaultdict(list)
    for r in multi.paths_of_roots(order, h.middles(), 40, SEED, used).collect():
        got[r.question].append(r)
    every = [r.name for rows in got.values() for r in rows]
    assert len(got) > 30 and len(every) == len(set(every)) and not set(every) & {r.name for r in used.collect()}
    rights = Counter()
    for rows in got.values():
        assert len(rows) == 5
        right = [r for r in rows if r.right]
        rights[len(right)] += 1
        assert len({leaves[r.name][0] for r in right}) == len(right)
        for r in rows:
            path, true = r.option.split(" > "), leaves[r.name]
            assert (path == true) == r.right and path[-1] == r.name and len(path) == len(true)
            assert all(n == true[0] or n not in true for n in path[:-1]) if not r.right else True
    assert {0, 1, 2, 3} & set(rights) and max(rights) >= 2
    assert any(r.option.split(" > ")[0] != leaves[r.name][0] for rows in got.values() for r in rows if not r.right)
    qs = multi.a4_roots(order, h.middles(), 40, SEED, used).collect()
    assert {q.question for q in qs} == set(got) and all(("other > " in "|".join(q.options)) <= ("footnote" in q.text or "'other' includes" in q.text) for q in qs)
    assert not any("defected >" in o for q in qs for o in q.options) and any("'other' includes" in q.text for q in qs) and not all("'other' includes" in q.text for q in qs)
    for q in qs:
        assert sorted(q.names) == sorted(r.name for r in got[q.question]) and len([x for x in q.correct.split(",") if x]) == sum(r.right for r in got[q.question])
    assert multi.paths_of_roots(order.limit(0), h.middles(), 4, SEED).count() == 0


def test_options_of_deep_pairs(spark, wheel):
    h, parent = wheel
    order, fam = places.preorder(h), places.family(h)
    pairs = places.deep_pairs(h, order, 6, SEED).select("a", "b")
    got = defaultdict(list)
    for r in multi.ancestors_of_pairs(pairs, order, fam, "ROOT", SEED).collect():
        got[r.a, r.b].append(r)
    asked = {(r.a, r.b) for r in pairs.collect()}
    assert set(got) <= asked and len(got) > 0.8 * len(asked)
    tiers = Counter()
    for (a, b), rows in got.items():
        above = [set(path_of(x, parent)[:-1]) for x in (a, b)]
        common, alone = above[0] & above[1], (above[0] ^ above[1]) - {a, b}
        assert len(rows) == len({r.option for r in rows}) == 5 and not {a, b} & {r.option for r in rows}
        for r in rows:
            assert (r.option in common) == r.right
            assert r.tier != "one" or r.option in alone
            assert r.tier != "child" or parent[r.option] in common
            assert r.tier != "far" or path_of(r.option, parent)[1] in {path_of(a, parent)[1], path_of(b, parent)[1]}
        mine = Counter(r.tier for r in rows)
        assert not mine["child"] or mine["one"] == len(alone)  # a tier is used up before the next
        tiers.update(mine)
    assert tiers["one"] and tiers["child"]
    one = pairs.limit(1).collect()[0]
    qs = multi.a5_pairs(h, 6, SEED, spark.createDataFrame([(one.b, one.a)], "a string, b string"), spark.createDataFrame([(sorted(parent)[0],)], "name string")).collect()
    assert qs and all({q.a, q.b} != {one.a, one.b} and sorted(parent)[0] not in (q.a, q.b) for q in qs)


def test_footnote(spark):
    df = spark.createDataFrame([(1, ["a", "other"]), (2, ["a > other > b"]), (3, ["mother"]), (4, None)], "i int, o array<string>")
    whole = {r.i: r.t for r in df.select("i", text.with_footnote(F.lit("Q"), F.col("o")).alias("t")).collect()}
    part = {r.i: r.t for r in df.select("i", text.with_footnote(F.lit("Q"), F.col("o"), whole=False).alias("t")).collect()}
    assert whole == {1: "Q" + text.FOOTNOTE, 2: "Q", 3: "Q", 4: "Q"} and part == {1: "Q" + text.FOOTNOTE, 2: "Q" + text.FOOTNOTE, 3: "Q" + text.FOOTNOTE, 4: "Q"}


def test_questions_as_displayed(spark):
    rows = [
        (1, "A1_root", "x", "Is 'x'?", ["defected", "b"]), (2, "E1", "x", "Like 'x'?", ["a > defected > c", "c > a > defected"]), (3, "E2", "defected", "Near 'defected'?", ["a", "b"]), (4, "A2", "defected", "Is 'defected'?", ["Yes", "No"]),
        (5, "E3", "x", "Odd?", ["defected one", "b"]), (6, "A4", "x", "Path?", ["r → defected → x", "defected > y"]), (7, "A1", "defected", None, None),
    ]
    got = {r.id: (r.text, r.options) for r in generate.displayed(spark.createDataFrame(rows, "id int, task_type string, name string, text string, options array<string>")).collect()}
    assert got == {
        1: ("Is 'x'?" + text.FOOTNOTE, ["other", "b"]), 2: ("Like 'x'?" + text.FOOTNOTE, ["a > other > c", "c > a > other"]), 3: ("Near 'other'?" + text.FOOTNOTE, ["a", "b"]), 4: ("Is 'defected'?", ["Yes", "No"]),
        5: ("Odd?", ["defected one", "b"]), 6: ("Path?", ["r → other → x", "other > y"]), 7: (None, None),
    }
