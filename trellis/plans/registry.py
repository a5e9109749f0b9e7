"""Registration of queries with their SQL, and the SQL of the derived inputs, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}

#: Derived inputs in SQL, by name; {name} in a query's SQL pulls in the ones it uses.
INPUTS = {
    "questions": """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS pos, o_orderpriority AS task_type,
        ' Which of these is like ' || (o_custkey % 97) || '? ' AS text, 'd' || (o_custkey % 300) AS descriptor,
        'o' || (o_custkey % 5) AS oa, 'o' || ((o_custkey + 1) % 5) AS ob, 'o' || (o_orderkey % 7) AS oc,
        CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS correct FROM orders""",
    "audit": """SELECT CAST(o_orderkey AS VARCHAR) AS question_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'flagged' END AS status, o_orderdate AS ts
        FROM orders WHERE o_orderstatus IN ('F', 'P')""",
    "results": """SELECT CAST(l_orderkey AS VARCHAR) AS question_id, 'm' || (l_suppkey % 11) AS model, CASE l_linestatus WHEN 'F' THEN 'no_tool' ELSE 'tool' END AS condition,
        'T' || l_linenumber AS task_type, l_discount * 10 AS score, l_discount >= 0.05 AS is_correct,
        CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'parse_error' ELSE 'no_judge' END AS status,
        CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 6 AS INTEGER) END AS judge_score,
        CAST(trunc(l_quantity) AS BIGINT) AS total_tokens, CAST(trunc(l_extendedprice) AS BIGINT) AS latency_ms, l_shipdate AS mtime, l_partkey AS pos FROM lineitem""",
    "responses": """SELECT event_id AS id, CASE event_id % 5 % 3 WHEN 0 THEN 'x/mistral-medium' WHEN 1 THEN 'x/gpt-oss-120b' ELSE 'x/other' END AS model,
        chr(CAST(event_id % 4 + 65 AS INTEGER)) AS one, CASE WHEN event_id % 97 <> 0 THEN CASE event_id % 12
          WHEN 0 THEN 'Therefore, I select (' || chr(CAST(event_id % 4 + 65 AS INTEGER)) || ').'
          WHEN 1 THEN 'I select **(' || chr(CAST(event_id % 4 + 65 AS INTEGER)) || ')**'
          WHEN 2 THEN 'The answer is ' || lower(chr(CAST(event_id % 4 + 65 AS INTEGER)))
          WHEN 3 THEN 'Well. I select (' || chr(CAST(event_id % 4 + 65 AS INTEGER))
          WHEN 4 THEN 'I select NONE'
          WHEN 5 THEN '<think>I select (' || chr(CAST(event_id % 4 + 65 AS INTEGER)) || ')' || chr(10) || 'as ever</think> Nothing <reasoning> more </reasoning>here. '
          WHEN 6 THEN 'First, one. Then I would choose (' || chr(CAST(event_id % 4 + 65 AS INTEGER)) || ') or so!' || chr(10) || 'Or (' || chr(CAST(event_id % 3 + 65 AS INTEGER)) || '). Done.'
          WHEN 7 THEN 'no idea at all'
          WHEN 8 THEN 'Therefore, I select (' || chr(CAST(event_id % 6 + 65 AS INTEGER)) || ', C).'
          WHEN 9 THEN 'answer is ' || chr(CAST(event_id % 6 + 65 AS INTEGER)) || ', D, F'
          WHEN 10 THEN 'Fine work.' || chr(10) || 'Score: ' || (event_id % 6) || chr(10) || 'I pick it.'
          ELSE 'I give this a solid ' || (event_id % 6) || ' in all; it was 3 or 4 at first' END END AS text FROM events""",
    "calls": """SELECT user_id AS conversation, ts, event_id, CASE event_type WHEN 'view' THEN 'validate_descriptors' WHEN 'click' THEN 'get_parent' WHEN 'purchase' THEN 'get_children' ELSE 'answer' END AS tool,
        array_to_string(list_sort(['k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 9), 'k3']), ',') AS args, CAST(floor(value) AS BIGINT) AS tokens FROM events""",
    "tree": """SELECT 'ROOT' AS source, r_name AS target, 'sub-category' AS path_type, CAST(r_regionkey + 1 AS BIGINT) AS eid FROM region
        UNION ALL SELECT r_name, n_name, 'sub-category', CAST(n_nationkey + 100 AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_name, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'related' ELSE 'sub-category' END, c_custkey + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dag": """SELECT 'ROOT' AS source, n_name AS target, CAST(n_nationkey + 1 AS BIGINT) AS eid FROM nation
        UNION ALL SELECT n_name, s_name, s_suppkey + 1000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT s_name, 'part' || l_partkey, l_partkey + 10000000 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey""",
    "tree_nodes": "SELECT target AS name, eid AS ord FROM tree UNION ALL SELECT 'ROOT', 0",
    "dag_nodes": "SELECT target AS name, min(eid) AS ord FROM dag GROUP BY target UNION ALL SELECT 'ROOT', 0",
    "dag_first": "SELECT d.target AS name, arg_min(d.source, (n.ord, d.source)) AS parent FROM dag d JOIN dag_nodes n ON n.name = d.source GROUP BY d.target",
    "dag_chain": """SELECT name, parent AS ancestor, 1 AS dist FROM dag_first UNION ALL SELECT c.name, f.parent, c.dist + 1 FROM dag_chain c JOIN dag_first f ON f.name = c.ancestor""",
    "tree_chain": """SELECT target AS name, source AS ancestor, 1 AS dist FROM tree UNION ALL SELECT c.name, t.source, c.dist + 1 FROM tree_chain c JOIN tree t ON t.target = c.ancestor""",
    "tree_self": "SELECT name, ancestor, dist FROM tree_chain UNION ALL SELECT name, name, 0 FROM tree_nodes",
    "pairs": """SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS a, 'Customer#' || lpad(CAST(c_custkey * 7 % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0') AS b FROM customer""",
}
_NEEDS = {"tree_nodes": ["tree"], "dag_nodes": ["dag"], "dag_first": ["dag", "dag_nodes"], "dag_chain": ["dag_first"], "tree_chain": ["tree"], "tree_self": ["tree_chain", "tree_nodes"]}
_RECURSIVE = {"dag_chain", "tree_chain"}


def _with(names: list[str]) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return ""
    return "WITH RECURSIVE " + ",\n".join(f"{n}{'(name, ancestor, dist)' if n in _RECURSIVE else ''} AS ({INPUTS[n]})" for n in order)


def query(sql: str | None, *inputs: str) -> Callable[[Plan], Plan]:
    """Registers a plan under its name; ``sql`` continues after the CTEs of ``inputs``, or begins with further ones and a comma."""

    def register(f: Plan) -> Plan:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = _with(list(inputs))
            body = sql.strip()
            ORACLE[f.__name__] = f"{head}{body}" if body.startswith(",") else f"{head}\n{body}"
        return f

    return register
