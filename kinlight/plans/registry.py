"""A registry of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The domain tables in SQL, as common table expressions.
VIEWS = {
    "photos": """photos AS (SELECT o_orderkey AS photo_id, '/lib/' || o_custkey || '/IMG_' || o_orderkey || '.jpg' AS path,
        CAST(round(o_totalprice * 100) AS BIGINT) AS file_size, o_orderdate AS taken_utc, o_orderpriority AS camera,
        CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 2 ELSE 99 END AS state FROM orders)""",
    "faces": """faces AS (SELECT l_orderkey AS photo_id, l_suppkey AS person_id, l_linestatus AS detector_id, l_returnflag <> 'R' AS active,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS assignment, l_quantity AS bbox_w, 1 - l_discount AS det_score,
        l_partkey AS cluster_id FROM lineitem)""",
    "persons": "persons AS (SELECT s_suppkey AS person_id, s_name AS display_name FROM supplier)",
    "appear": "appear AS (SELECT DISTINCT photo_id, person_id FROM faces WHERE active)",
    "vectors": "vectors AS (SELECT vec_id AS face_id, embedding::DOUBLE[] AS vector, label, label * 10 + vec_id % 10 AS person_id FROM embeddings)",
    "centroids": """parts AS (SELECT person_id, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM vectors),
        sums AS (SELECT person_id, pos, sum(x) AS s FROM parts GROUP BY person_id, pos),
        lengths AS (SELECT person_id, sqrt(sum(s * s)) AS l FROM sums GROUP BY person_id),
        centroids AS (SELECT person_id, list(s / l ORDER BY pos) AS centroid FROM sums JOIN lengths USING (person_id) GROUP BY person_id)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(VIEWS[n] for n in names)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL for the same rows where there is some."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add
