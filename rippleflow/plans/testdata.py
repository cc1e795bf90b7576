"""Star-schema tables as the relations of §1 of the data model, alike in Spark SQL and DuckDB.

An adapter is SQL over tables and other adapters, named in braces. Only integers and strings are
computed. @sha@ and @div@ stand for what the engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
_SPELLING = {"spark": {"@sha@": "hex256", "@div@": "div"}, "duck": {"@sha@": "sha256", "@div@": "//"}}

_CUST = "CAST(o_custkey % 50 AS STRING)"
_BODY = "o_orderstatus || o_orderpriority || CAST(o_orderkey AS STRING)"
_FQN = "CASE WHEN o_orderkey % 31 = 0 THEN 'T' || CAST(o_orderkey AS STRING) || '::<type>' ELSE 'System.Int32 T' || CAST(o_custkey % 500 AS STRING) || '::M' || CAST(o_orderkey AS STRING) || '(' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'A`2<B,C>,D' ELSE 'A,B[,],C' END || ')' END"

ADAPTERS: dict[str, str] = {
    # two snapshots; one assembly is new, one gone, some have another case
    "method_base": f"SELECT 'A' || {_CUST} AS assembly, CAST(o_orderkey AS INT) AS token, {_FQN} AS fqn, upper(substr(@sha@({_BODY}), 1, 32)) AS hash, 0 AS v FROM {{orders}} WHERE (o_orderkey % 97 <> 0 OR o_custkey % 50 < 20) AND o_custkey % 50 <> 49",
    "method_cur": f"SELECT CASE WHEN o_custkey % 7 = 0 AND o_custkey % 50 = 7 THEN 'a7' WHEN o_custkey % 50 = 7 THEN 'a7' ELSE 'A' || {_CUST} END AS assembly, CAST(o_orderkey AS INT) AS token, {_FQN} AS fqn, upper(substr(@sha@(CASE WHEN o_orderkey % 53 = 0 AND o_custkey % 50 >= 30 THEN 'x' ELSE '' END || {_BODY}), 1, 32)) AS hash, CASE WHEN o_orderkey % 53 = 0 AND o_custkey % 50 >= 30 THEN 1 ELSE 0 END AS v FROM {{orders}} WHERE (o_orderkey % 89 <> 0 OR o_custkey % 50 < 20) AND o_custkey % 50 <> 48",
    "assembly_base": "SELECT assembly AS name, '' AS mvid, @sha@(CAST(count(*) AS STRING) || ':' || CAST(sum(token) AS STRING) || ':' || CAST(sum(token * v) AS STRING)) AS content_hash, CAST(substr(assembly, 2) AS INT) % 5 <> 4 AS methods_analyzed FROM {method_base} GROUP BY assembly",
    "assembly_cur": "SELECT assembly AS name, '' AS mvid, @sha@(CAST(count(*) AS STRING) || ':' || CAST(sum(token) AS STRING) || ':' || CAST(sum(token * v) AS STRING)) AS content_hash, CAST(substr(assembly, 2) AS INT) % 5 <> 4 AS methods_analyzed FROM {method_cur} GROUP BY assembly",
    "content_base": "SELECT 'F' || CAST(p_partkey AS STRING) || '.json' AS name, upper(@sha@(p_brand)) AS hash FROM {part} WHERE p_partkey % 211 <> 3",
    "content_cur": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'f' ELSE 'F' END || CAST(p_partkey AS STRING) || '.json' AS name, upper(@sha@(CASE WHEN p_partkey % 17 = 0 THEN 'y' ELSE '' END || p_brand)) AS hash FROM {part} WHERE p_partkey % 19 <> 0",
    # dependency edges: part, order, customer, nation, region
    "edge": "SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING) AS callee, 'O:' || CAST(l_orderkey AS STRING) AS caller FROM {lineitem} UNION ALL SELECT 'O:' || CAST(o_orderkey AS STRING), 'C:' || CAST(o_custkey AS STRING) FROM {orders} UNION ALL SELECT 'C:' || CAST(c_custkey AS STRING), 'N:' || CAST(c_nationkey AS STRING) FROM {customer} UNION ALL SELECT 'N:' || CAST(n_nationkey AS STRING), 'R:' || CAST(n_regionkey AS STRING) FROM {nation}",
    "seed": "SELECT 'P:' || CAST(p_partkey AS STRING) AS node FROM {part} WHERE p_partkey % 400 = 7",
    "edge_cyclic": "SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING) AS callee, 'S:' || CAST(l_suppkey AS STRING) AS caller FROM {lineitem} UNION ALL SELECT DISTINCT 'S:' || CAST(l_suppkey AS STRING), 'P:' || CAST(l_partkey AS STRING) FROM {lineitem}",
    "test": "SELECT 'C:' || CAST(c_custkey AS STRING) AS key, c_name AS display_name, 'N' || CAST(c_nationkey AS STRING) AS assembly, 'C:' || CAST(c_custkey AS STRING) AS declaring_type, c_custkey % 3 = 0 AS parameterized, c_mktsegment AS namespace, c_mktsegment AS class_name FROM {customer}",
    "base_type": "SELECT 'C:' || CAST(c_custkey AS STRING) AS type, 'C:' || CAST(c_custkey @div@ 2 AS STRING) AS base FROM {customer} WHERE c_custkey > 0",
    "lifecycle": "SELECT 'N:' || CAST(n_nationkey AS STRING) AS method_key, CAST(1 + n_nationkey % 2 AS INT) AS scope, 'C:' || CAST(n_nationkey + 1 AS STRING) AS declaring_type, 'n' || CAST(n_nationkey AS STRING) AS assembly FROM {nation}",
    "hook_global": "SELECT 'R:' || CAST(r_regionkey AS STRING) AS method_key, 3 AS scope, 'R' AS declaring_type, 'R' AS assembly FROM {region} WHERE r_regionkey = 2",
    "ref": "SELECT 'N' || CAST(c_nationkey AS STRING) AS name, 'X' || CAST(c_custkey AS STRING) AS ref FROM {customer} UNION SELECT 'X' || CAST(c_custkey AS STRING), 'x' || CAST(CASE WHEN c_custkey = 0 THEN 2 ELSE c_custkey @div@ 3 END AS STRING) FROM {customer}",
    "version": "SELECT 'f' || CAST(user_id AS STRING) AS file, CAST(user_id % 4 AS INT) AS dir_index, 'p' || CAST(event_id AS STRING) AS path, CAST((event_id * 7919) % 1000 AS INT) AS modified FROM {events}",
    "path": "SELECT page_id, url FROM {pages} WHERE url IS NOT NULL",
    "name": "SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '<M' || CAST(o_custkey AS STRING) || '>b__' || CAST(o_orderkey % 9 AS STRING) || '_' || CAST(o_orderkey % 3 AS STRING) WHEN 1 THEN '<M' || CAST(o_custkey AS STRING) || '>d__' || CAST(o_orderkey % 90 AS STRING) WHEN 2 THEN 'T/<>c__DisplayClass' || CAST(o_orderkey % 90 AS STRING) || '_0' WHEN 3 THEN '<>9__' || CAST(o_orderkey % 90 AS STRING) || '_1' WHEN 4 THEN '<M' || CAST(o_custkey AS STRING) || '>g__Local|' || CAST(o_orderkey % 90 AS STRING) || '_2' WHEN 5 THEN 'Plain' || CAST(o_orderkey AS STRING) ELSE 'call m: <A>b__1_2 and <B>d__33::x' END AS name FROM {orders}",
    "listed": "SELECT CAST(o_orderkey AS INT) AS line_no, 'given' AS source, CASE o_orderkey % 9 WHEN 0 THEN 'src/a' || CAST(o_custkey AS STRING) || '.cs' WHEN 1 THEN ' src/b.cs:' || CAST(o_custkey AS STRING) WHEN 2 THEN 'src/c.cs:' || CAST(o_custkey % 50 AS STRING) || '-' || CAST(o_custkey AS STRING) WHEN 3 THEN '# note' WHEN 4 THEN 'C:/d.cs' WHEN 5 THEN 'e.cs:0' WHEN 6 THEN 'f.cs:12-3' WHEN 7 THEN 'g:h.cs:7-7' ELSE '   ' END AS line FROM {orders}",
    "hunk": "SELECT 's' || CAST(o_custkey AS STRING) AS source, CAST(o_orderkey AS INT) AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN '+++ b/dir/f' || CAST(o_orderkey AS STRING) || '.cs' WHEN o_orderkey % 23 = 1 THEN '+++ /dev/null' WHEN o_orderkey % 7 = 2 THEN '@@ -1,3 +' || CAST(o_orderkey % 40 AS STRING) || ',0 @@ ctx' WHEN o_orderkey % 7 = 3 THEN '+ added line' ELSE '@@ -5 +' || CAST(o_orderkey % 900 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ',' || CAST(1 + o_orderkey % 6 AS STRING) ELSE '' END || ' @@' END AS line FROM {orders}",
    "point": "SELECT 'A' || CAST(o_custkey % 9 AS STRING) AS assembly, 'F' || CAST(l_orderkey AS STRING) AS method_fqn, '/src/d' || CAST(l_orderkey % 100 AS STRING) || '/f' || CAST(l_orderkey @div@ 10 AS STRING) || '.cs' AS document, CAST(l_linenumber * 10 + l_partkey % 7 AS INT) AS start_line, CAST(l_linenumber * 10 + 9 AS INT) AS end_line, l_linenumber % 5 = 4 AS hidden FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "range": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'repo/' ELSE '' END || 'D' || CAST((c_custkey * 10 + c_custkey % 10) % 100 AS STRING) || '/f' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 41 = 5 THEN '.txt' ELSE '.cs' END AS path, CAST(c_custkey % 60 AS INT) AS start_line, CAST(c_custkey % 60 + 4 AS INT) AS end_line FROM {customer}",
    "instruction": "SELECT 'A' AS assembly, 'O' || CAST(l_orderkey AS STRING) AS fqn, CAST(l_linenumber AS INT) AS place, CASE WHEN min(l_partkey) % 3 = 0 THEN 'nop' ELSE 'op' || CAST(min(l_partkey) % 5 AS STRING) END AS opcode, CASE min(l_partkey) % 4 WHEN 0 THEN 'm' WHEN 1 THEN 's' WHEN 2 THEN '@' END AS operand_kind, CASE min(l_partkey) % 4 WHEN 0 THEN 'T::M' || CAST(min(l_suppkey) AS STRING) WHEN 1 THEN 'text' END AS operand, CAST(1 + min(l_suppkey) % 7 AS INT) AS target FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "member": "SELECT 'A' AS assembly, 'T' || CAST(o_custkey AS STRING) AS type, 'M' || CAST(o_orderkey % 6 AS STRING) AS name, CAST(o_orderkey % 3 AS INT) AS params, 'F' || CAST(o_orderkey AS STRING) AS fqn, (o_orderkey @div@ 10) % 4 <> 0 AS is_virtual, false AS is_static, false AS is_ctor FROM {orders}",
    "type": "SELECT 'A' AS assembly, 'T' || CAST(c_custkey AS STRING) AS type, 'T' || CAST(c_custkey AS STRING) AS simple_name, CAST(NULL AS STRING) AS declaring_type, CASE WHEN c_custkey > 0 THEN 'T' || CAST(c_custkey @div@ 3 AS STRING) ELSE '' END AS base FROM {customer}",
    "interface": "SELECT 'T' || CAST(c_custkey AS STRING) AS type, 'T' || CAST(c_custkey @div@ 5 AS STRING) AS interface FROM {customer} WHERE c_custkey > 0",
    "nested": "SELECT 'A' AS assembly, 'T' || CAST(c_custkey AS STRING) AS type, CASE WHEN c_custkey % 3 = 0 THEN '<>c' ELSE 'N' || CAST(c_custkey AS STRING) END AS simple_name, CASE WHEN c_custkey % 7 <> 5 AND c_custkey > 0 THEN 'T' || CAST(c_custkey @div@ 2 AS STRING) END AS declaring_type, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'B' || CAST(c_nationkey AS STRING) END AS base, CAST(c_custkey % 5 AS INT) AS arity, CAST(-c_nationkey AS INT) AS flags FROM {customer}",
    "field": "SELECT 'A' AS assembly, 'T' || CAST(o_custkey AS STRING) AS type, 'f' || CAST(o_orderkey AS STRING) AS name, o_orderstatus AS field_type, CAST(o_orderkey % 9 AS INT) AS flags, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS constant FROM {orders}",
    "code": "SELECT 'A' AS assembly, 'F' || CAST(l_orderkey AS STRING) AS fqn, CASE l_linenumber % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 's' END AS operand_kind, 'T' || CAST(l_partkey AS STRING) AS target_type, 'M' || CAST(l_suppkey % 6 AS STRING) AS target_name, CAST(l_linenumber % 4 AS INT) AS target_params, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'Other' END AS target_scope, CASE WHEN l_linenumber % 3 <> 2 AND l_partkey % 5 = 0 THEN 'G' || CAST(l_partkey AS STRING) WHEN l_partkey % 7 = 1 THEN '!0' END AS type_arg FROM {lineitem}",
    "provider_ref": "SELECT 'T' || CAST(c_custkey AS STRING) AS type, CASE WHEN c_custkey % 5 = 0 THEN '*' WHEN c_custkey % 5 = 1 THEN 'None' ELSE 'M' || CAST(c_custkey % 6 AS STRING) END AS member, 'C:' || CAST(c_custkey AS STRING) AS test_key FROM {customer}",
    "candidate": "SELECT 'p' || CAST(s_suppkey AS STRING) AS project, '/out/p' || CAST(s_suppkey AS STRING) || '/bin/net' || CAST(6 + n AS STRING) || '.0' AS directory FROM {supplier} JOIN (SELECT n_nationkey AS n FROM {nation} WHERE n_nationkey < 4) ON s_suppkey % 4 >= n",
    "tfm_attribute": "SELECT CAST(n_nationkey AS INT) AS \"order\", CASE n_nationkey % 3 WHEN 0 THEN '.NETCoreApp,Version=v' || CAST(n_nationkey % 11 AS STRING) || '.' || CAST(n_nationkey % 4 AS STRING) WHEN 1 THEN '.NETStandard,Version=v2.1' ELSE '.NETCoreApp,Version=v' || CAST(n_nationkey % 10 AS STRING) || '.0' END AS tfm FROM {nation}",
}
_REF = re.compile(r"\{(\w+)\}")


def _spelt(sql: str, engine: str) -> str:
    for token, text in _SPELLING[engine].items():
        sql = sql.replace(token, text)
    return sql


def needed(names: list[str]) -> list[str]:
    """Adapters that these need, in an order in which each comes after what it needs."""
    out: list[str] = []

    def add(n: str) -> None:
        if n in ADAPTERS and n not in out:
            for m in _REF.findall(ADAPTERS[n]):
                add(m)
            out.append(n)

    for n in names:
        add(n)
    return out


class Relations:
    """Adapters as DataFrames over a directory's tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in ADAPTERS:
                text = re.sub(r"hex256\(", "sha2_256(", _spelt(ADAPTERS[name], "spark")).replace('"order"', "`order`")
                text = _sha2(text)
                parts = {n: self[n] for n in _REF.findall(ADAPTERS[name])}
                self.known[name] = self.spark.sql(text, **parts)
            else:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.known[name]


def _sha2(text: str) -> str:
    """sha2_256(x) to sha2(x, 256), by matching brackets."""
    while (at := text.find("sha2_256(")) >= 0:
        depth, i = 0, at + len("sha2_256")
        while True:
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                break
            i += 1
        text = f"{text[:at]}sha2({text[at + 9 : i]}, 256){text[i + 1 :]}"
    return text


def duck(names: list[str], select: str, recursive: bool = False) -> str:
    """DuckDB SQL: the adapters as common table expressions, then a query over them."""
    parts = [f"{n} AS ({_REF.sub(lambda m: m[1], _spelt(ADAPTERS[n], 'duck'))})" for n in needed(names)]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}{', ' if parts and select.startswith('+') else ''}\n{select.lstrip('+')}"
