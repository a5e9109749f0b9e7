"""Drawing of descriptors under limits that hold for a whole run, or for all runs so far, as joins and sums.

``capped`` gives each draw a descriptor such that none is used too often, in rounds: every open draw picks by hash among
what is left, and a descriptor that is asked for too often hands back the draws of the lowest priority. ``shared_out``
gives each request for a group another member of it, in one pass. ``without_used`` leaves out candidates whose
descriptors, sets or ordered tuples earlier runs have used.

All choices are hashes of the seed and what is drawn, so a rerun or another cluster gives the same. Rows with a null id,
task or name take no part; repeated ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..steps import dropped, kept, replaced
from .ordering import numbered, numbered_in
from .places import hashed

#: Which nodes the tasks draw from.
KINDS = {"A1": "leaf", "A2": "any", "A3": "middle", "A4": "leaf", "A5": "any", "E1": "any", "E2": "any", "E3": "middle", "F": "any"}


def pools(h) -> DataFrame:
    """(kind, name): leaves, middle nodes, and any node but the root."""
    kinds = {"leaf": h.leaves(), "middle": h.middles(), "any": h.nodes.select("name")}
    out = None
    for k, names in kinds.items():
        rows = names.where((F.col("name") != h.root) & F.col("name").isNotNull()).distinct().select(F.lit(k).alias("kind"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def capped(draws: DataFrame, kinds: DataFrame, most: int, seed: str, used: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(id, task, name, round): a descriptor for each of ``draws`` (id, task, kind) as long as there are any.

    A task uses a name once, all tasks together use it ``most`` times, its rows in ``used`` (name) included; names in
    ``excluded`` are not drawn. Draws for which nothing is left are missing. In a round the open draws of a task lie in an order by
    hash, and so does what is left of its pool, and the t-th draw asks for the t-th name; of the tasks that ask for one name the
    first by hash are heard, as far as it has uses left. As each name that is asked for takes a draw, rounds end; only draws
    that met with other tasks' go on to the next.
    """
    names = kinds.where("name is not null").join(excluded.select("name"), "name", "left_anti") if excluded is not None else kinds.where("name is not null")
    room = names.select("name").distinct().withColumn("room", F.lit(most))
    if used is not None:
        room = room.join(used.groupBy("name").count(), "name", "left").select("name", (F.col("room") - F.coalesce("count", F.lit(0))).cast("int").alias("room")).where("room > 0")
    room = kept(room)
    wait = kept(draws.where("id is not null and task is not null").dropDuplicates(["id"]).select("id", "task", "kind"))
    tasks = wait.select("task", "kind").distinct()
    free = kept(tasks.join(names, "kind").select("task", "kind", "name").distinct().join(room.select("name"), "name", "left_semi"))
    done, turn = [], 0
    while True:
        place = ["task", "kind", "_at"]
        lined = numbered_in(free.withColumns({"_t": F.concat_ws("|", "task", "kind"), "_h": F.expr(hashed(seed, f"concat('{turn}|', task, '|', name)"))}), "_t", ["_h", "name"], "_at", "_n").select(*place, "name")
        asked = numbered_in(wait.withColumns({"_t": F.concat_ws("|", "task", "kind"), "first": F.expr(hashed(seed, f"concat('first|{turn}|', id)"))}), "_t", ["first", "id"], "_at", "_n").select(*place, "id", "first")
        heard = asked.join(lined, place).drop("_at")
        heard = heard.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("first", "id"))).where(F.col("rank") <= most)
        given = kept(heard.join(room, "name").where("rank <= room").select("id", "task", "name", F.lit(turn).alias("round")))
        if given.isEmpty():
            break
        done.append(given)
        wait = replaced(wait.join(given.select("id"), "id", "left_anti"), wait)
        room = replaced(room.join(given.groupBy("name").count(), "name", "left").select("name", (F.col("room") - F.coalesce("count", F.lit(0))).cast("int").alias("room")).where("room > 0"), room)
        free = replaced(free.join(given.select("task", "name"), ["task", "name"], "left_anti").join(room.select("name"), "name", "left_semi").select("task", "kind", "name"), free)
        turn += 1
        if wait.isEmpty():
            break
    dropped(wait, room, free)
    if not done:
        return given
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def shared_out(requests: DataFrame, members: DataFrame, seed: str) -> DataFrame:
    """``requests`` (id, group) with ``name``: each another member of its group, all equally likely; null when a group has no more.

    Members (group, name) lie in an order by hash, and so do the requests of a group; the t-th request gets the t-th
    member. Both are numbered by ranges, so a group may hold any share of either.
    """
    lined = numbered(members.select("group", "name").distinct().withColumn("_h", F.expr(hashed(seed, "concat('member|', group, '|', name)"))), ["group", "_h", "name"], "_m")
    lined = kept(lined.drop("_h"))
    has = lined.groupBy("group").agg(F.min("_m").alias("_from"), F.count("*").alias("_n"))
    asked = kept(numbered(requests.withColumn("_h", F.expr(hashed(seed, "concat('request|', id)"))), ["group", "_h", "id"], "_r").drop("_h"))
    first = asked.groupBy("group").agg(F.min("_r").alias("_first"))
    at = F.when(F.col("_r") - F.col("_first") < F.col("_n"), F.col("_from") + F.col("_r") - F.col("_first"))
    placed = asked.join(first, "group").join(has, "group", "left").withColumn("_m", at).drop("_r", "_first", "_from", "_n")
    return placed.join(lined.select("_m", "name"), "_m", "left").drop("_m")


def ordered_key(names: Column) -> Column:
    """A key of names in their order; no two lists share one, whatever the names hold. Null if a name is null or empty, or there is none."""
    whole = (F.size(names) > 0) & ~F.exists(names, lambda x: F.coalesce(x == "", F.lit(True)))
    return F.when(whole, F.array_join(F.transform(names, lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"), x)), ""))


def set_key(names: Column) -> Column:
    """The key of names without their order and repeats."""
    return ordered_key(F.array_sort(F.array_distinct(names)))


#: Blocks of 64 bits in the filter, at most, as a power of two: 2^20 rows of 12 bytes are broadcast.
MOST_BLOCKS = 20


def _mask(hash_: str) -> str:
    """SQL of four bits of 64, from a hash."""
    return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({hash_}, {s}) & 63 as int))" for s in (0, 6, 12, 18))


def filter_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """(block, bits), and the number of blocks: a Bloom filter of the column ``key`` whose four bits lie in one block of 64."""
    many = keys.count()
    power = min(MOST_BLOCKS, max(4, (many // 4).bit_length()))
    rows = keys.withColumn("h", F.xxhash64("key")).select(F.expr(f"cast(shiftrightunsigned(h, 30) % {1 << power} as int)").alias("block"), F.expr(_mask("h")).alias("bits"))
    return rows.groupBy("block").agg(F.bit_or("bits").alias("bits")), 1 << power


def perhaps_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be in ``keys``: all that are and few others; nothing but the filter moves."""
    found, blocks = filter_of(keys)
    found = found.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    out = rows.withColumn("_h", F.xxhash64("key")).withColumn("_block", F.expr(f"cast(shiftrightunsigned(_h, 30) % {blocks} as int)"))
    return out.join(F.broadcast(found), "_block").where(F.expr(f"(_bits & ({_mask('_h')})) = ({_mask('_h')})")).drop("_h", "_block", "_bits")


def _key(when: Column, kind: str, key: Column) -> Column:
    return F.when(when & key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))


def _keys() -> list[Column]:
    """What a question uses: targets of E1, E2 and F, the sets of E1's and E2's candidates, E3's parents."""
    t = F.col("task")
    return [
        _key(t.isin("E1", "E2", "F"), "target", ordered_key(F.array("target"))),
        _key(t == "E1", "E1 set", set_key(F.col("candidates"))),
        _key(t == "E2", "E2 set", set_key(F.col("candidates"))),
        _key(t == "E3", "E3 parent", ordered_key(F.array("parent"))),
    ]


def candidate_keys(candidates: DataFrame, ranked: bool = False) -> DataFrame:
    """(id, kind, key): what each candidate question would use; with ``ranked`` also the order of E1's candidates, by which
    the same three may be asked again in another order if the kind ``E1 set`` is left out."""
    keys = _keys() + ([_key(F.col("task") == "E1", "E1 order", ordered_key(F.col("candidates")))] if ranked else [])
    return candidates.select("id", F.explode(F.array_compact(F.array(*keys))).alias("x")).select("id", "x.kind", "x.key")


def used_keys(questions: DataFrame, ranked: bool = False) -> DataFrame:
    """(kind, key) of what earlier ``questions`` (task, status, target, candidates, parent) have used; E3's parents of confirmed questions alone."""
    whole = questions.where((F.col("task") != "E3") | (F.col("status") == "confirmed"))
    return candidate_keys(whole.withColumn("id", F.lit(0)), ranked).select("kind", "key").distinct()


def without_used(candidates: DataFrame, earlier: DataFrame, kinds: tuple[str, ...] = ("target", "E1 set", "E2 set", "E3 parent")) -> DataFrame:
    """``candidates`` (id, task, target, candidates, parent) none of whose keys, of the ``kinds`` named, ``earlier`` has used.

    ``E1 order`` in place of ``E1 set`` forbids the same ranking, and lets the same candidates be ranked otherwise.

    The filter of used keys is broadcast (its size is bounded), so that of the candidates' keys only those move that may be
    used; they are then compared exactly.
    """
    whole = lambda df: df.where(F.col("kind").isin(*kinds)).withColumn("key", F.concat_ws("|", "kind", "key")).drop("kind")
    used = kept(whole(used_keys(earlier, True)))
    met = perhaps_in(whole(candidate_keys(candidates, True)), used).join(used, "key", "left_semi")
    return candidates.where("id is not null").join(met.select("id").distinct(), "id", "left_anti")
