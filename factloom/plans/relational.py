"""Relational queries that read the same in Spark SQL and in the SQL of the oracle.

Each is declarative, so the optimiser prunes columns, pushes filters to the scan and picks joins; every top-k
has a unique tie-breaker.  Tables are temporary views over the Parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES = {
    "scan_records": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey <> 7 AND o_totalprice < 100000",
    "filter_in_status": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "filter_notlike_null": "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT d.source ILIKE 'SRC1%' OR d.source IS NULL",
    "text_search": "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', coalesce(text, ''), coalesce(source, ''))), 'license')",
    "distinct_sources": "SELECT DISTINCT source, lang FROM documents",
    "join_left_source": "SELECT o.o_orderkey, c.c_name, c.c_acctbal FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0",
    "join_inner_changes": "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'",
    "join_left_evidence": "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "trace_value": "SELECT o.o_orderkey, l.l_linenumber, l.l_extendedprice FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority = '1-URGENT' AND l.l_quantity > 45",
    "candidates_topk": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 25",
    "already_done": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "missing_from_page": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "single_record_pages": "SELECT o_orderkey, o_custkey, n FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) t WHERE n = 1",
    "status_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS open, CAST(round(avg(CAST(o_totalprice AS DECIMAL(18, 2))), 1) AS DOUBLE) AS mean_price FROM orders",
    "count_by_status": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "sources_by_type": "SELECT d.source, count(*) AS urls, CAST(sum(l.toxic) AS BIGINT) AS toxic, count(l.quality) AS known FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source",
    "reconfirmed_runs": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type = 'click' GROUP BY user_id",
    "provenance_counts": "SELECT CASE WHEN position(':' IN via) > 0 THEN substr(via, 1, position(':' IN via) - 1) ELSE via END AS origin, count(*) AS n FROM (SELECT concat(lang, ':', source) AS via FROM documents) t GROUP BY 1",
    "run_summary": "SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY CAST(ts AS DATE)",
    "report_summary": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "topk_confidence": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "set_except_seen": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0",
    "latest_snapshot_text": "SELECT conv_id, turn, sha FROM (SELECT conv_id, turn, sha2(text, 256) AS sha, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r = 1",
    "prev_snapshot": "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations",
    "snapshot_changed": "SELECT user_id, event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS changed FROM events",
    "consecutive_failures": """
        SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) ELSE 0 END AS failures
        FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) t""",
    "recently_changed": "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-06-23' AND CAST(o_orderdate AS DATE) <= DATE '1998-06-30'",
    "content_dedup": "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS duplicate_of FROM documents",
    "closest_version": """
        SELECT o_custkey, o_orderkey, gap FROM (SELECT o_custkey, o_orderkey, abs(age - 365) AS gap, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(age - 365), o_orderkey) AS r
        FROM (SELECT o_custkey, o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30') AS age FROM orders) a WHERE age BETWEEN 60 AND 1000) t WHERE r = 1""",
    "status_transitions": """
        SELECT o_orderkey, o_orderstatus AS old_status, status AS new_status FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-30' THEN 'F' ELSE 'O' END AS status FROM orders) t
        WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> status""",
    "traceability": "SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_quantity > 10) AS DOUBLE) / count(*) AS share FROM lineitem GROUP BY l_orderkey",
    "upsert_last_wins": """
        SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY version DESC, tie DESC, v DESC) AS r FROM (
          SELECT l_orderkey AS k, l_extendedprice AS v, 0 AS version, l_linenumber AS tie FROM lineitem WHERE l_linenumber = 1
          UNION ALL SELECT l_orderkey, l_extendedprice, 1, l_linenumber FROM lineitem WHERE l_linenumber > 1 AND l_returnflag = 'R') u) t WHERE r = 1""",
    "insert_ignore": """
        SELECT o_custkey AS k, 'old' AS origin FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0) a
        UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders n WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey % 2 = 0 AND x.o_custkey = n.o_custkey)""",
    "conditional_update": "SELECT o.o_orderkey, CASE WHEN p.k IS NOT NULL THEN DATE '1998-06-30' ELSE CAST(o.o_orderdate AS DATE) END AS last_verified FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 48) p ON p.k = o.o_orderkey",
    "rejected_claims": "SELECT l_orderkey, l_linenumber, l_extendedprice AS raw_value FROM lineitem WHERE l_discount = 0 AND l_extendedprice IS NOT NULL",
    "incremental_skip": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT text, doc_id FROM documents WHERE doc_id % 2 = 0) s WHERE s.text = d.text AND s.doc_id <> d.doc_id)",
    "quote_exact": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "export_flat": "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "present_table": "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END, 'Not specified') AS label FROM orders",
}
#: The same with two sides that together hold every row: a predicate and its complement, and an overlap whose values differ.
_SIDE_A, _SIDE_B = "l_suppkey % 3 IS DISTINCT FROM 0", "l_suppkey % 3 IS NOT DISTINCT FROM 0 OR l_suppkey % 2 = 0"
QUERIES |= {
    "set_union_urls_all": "SELECT url FROM pages WHERE page_id % 2 IS NOT DISTINCT FROM 0 UNION SELECT url FROM pages WHERE page_id % 2 IS DISTINCT FROM 0 OR page_id % 3 = 0",
    "merge_missing_all": f"""
        SELECT coalesce(a.l_orderkey, b.l_orderkey) AS record, coalesce(a.l_linenumber, b.l_linenumber) AS field, coalesce(a.price, b.price) AS price, a.here IS NULL AS filled
        FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, 1 AS here FROM lineitem WHERE {_SIDE_A}) a
        FULL OUTER JOIN (SELECT l_orderkey, l_linenumber, l_extendedprice + 1 AS price FROM lineitem WHERE {_SIDE_B}) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
    "field_changes_all": f"""
        SELECT coalesce(a.l_orderkey, b.l_orderkey) AS record, coalesce(a.l_linenumber, b.l_linenumber) AS field,
          CASE WHEN a.here IS NULL THEN 'newly stated' WHEN b.here IS NULL THEN 'no longer stated' ELSE 'value changed' END AS note
        FROM (SELECT l_orderkey, l_linenumber, l_quantity AS v, 1 AS here FROM lineitem WHERE {_SIDE_A}) a
        FULL OUTER JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_quantity + 1 ELSE l_quantity END AS v, 1 AS here FROM lineitem WHERE {_SIDE_B}) b
          ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.here IS NULL OR b.here IS NULL OR a.v IS DISTINCT FROM b.v""",
}
#: Spellings that differ in the oracle.
_ORACLE = {"sha2(text, 256)": "sha256(text)"}
_SPARK = {"datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30')": "datediff(DATE '1998-06-30', CAST(o_orderdate AS DATE))"}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _spell(sql: str, changes: dict[str, str]) -> str:
    for a, b in changes.items():
        sql = sql.replace(a, b)
    return sql


def run(spark: SparkSession, sf_dir: str, sql: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of sql.  made: subqueries (their text, without brackets) whose rows are there already and aren't derived again wherever sql nests them."""
    views = {}
    for i, (text, rows) in enumerate((made or {}).items()):
        if f"({text})" in sql:
            sql, views[f"made_{i}"] = sql.replace(f"({text})", f"{{made_{i}}}"), rows
    for name in _TABLES:
        if f" {name}" in sql or f"({name}" in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(_spell(sql, _SPARK), **views)


#: The plain names read every row, too.
QUERIES |= {"set_union_urls": QUERIES["set_union_urls_all"], "merge_missing": QUERIES["merge_missing_all"]}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)) for k, sql in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _spell(sql, _ORACLE) for k, sql in QUERIES.items()}
