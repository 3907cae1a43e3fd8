"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from binwright.sources.star import StarTables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_CELLS = """
    SELECT o_orderkey AS id, c_nationkey::BIGINT AS ingest_id, 'cell_' || o_orderkey::VARCHAR AS original_id,
           o_custkey::VARCHAR AS donor_id, o_orderpriority AS cell_type, o_orderstatus AS disease,
           c_mktsegment AS tissue, o_totalprice AS score
    FROM orders JOIN customer ON o_custkey = c_custkey"""

# Views of the star tables, as in ``sources.star``, in an order where each may use earlier ones.
VIEWS = {
    "cells": _CELLS,
    "cells_with_nulls": """
    SELECT * REPLACE (CASE WHEN id % 50 <> 0 THEN tissue END AS tissue,
                      CASE WHEN id % 70 <> 0 THEN cell_type END AS cell_type) FROM cells""",
    "ingests": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation",
    "features": """
    SELECT p_partkey AS id, 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') AS ensemble_id, p_name AS symbol,
           p_type AS biotype, p_size AS size FROM part""",
    "wanted_features": """
    SELECT row_number() OVER (ORDER BY id) - 1 AS id, symbol, ensemble_id FROM features WHERE size <= 10""",
    "counts": """
    SELECT l_orderkey AS cell_id, l_partkey AS feature_id, sum(l_quantity)::BIGINT AS raw_count
    FROM lineitem GROUP BY ALL""",
    "event_cells": """
    SELECT event_id AS id, event_type AS cell_type, user_id::VARCHAR AS donor_id, props AS metadata_extra, value
    FROM events""",
    "random_binned": """
    SELECT *, (row_number() OVER (ORDER BY shuffle_key, id) - 1) // 1000 AS extract_bin
    FROM (SELECT *, {hash:id:7} AS shuffle_key FROM cells)""",
    "keyed_binned": """
    SELECT *, dense_rank() OVER (ORDER BY category NULLS FIRST, chunk) - 1 AS extract_bin
    FROM (SELECT *, (rn - 1) // 100 AS chunk
          FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY shuffle_key, id) AS rn
                FROM (SELECT *, tissue || '##' || cell_type AS category, {hash:id:3} AS shuffle_key
                      FROM cells_with_nulls)))""",
    "packed": """
    SELECT b.extract_bin, c.cell_id, w.id AS feature_id, c.raw_count
    FROM counts c JOIN features f ON c.feature_id = f.id JOIN wanted_features w ON f.ensemble_id = w.ensemble_id
    JOIN random_binned b ON c.cell_id = b.id""",
    "file_obs": """
    SELECT 'file_' || lpad((id % 25)::VARCHAR, 3, '0') AS file, id // 25 AS row_pos, original_id AS obs_id, id AS source_id,
           donor_id AS donor, cell_type, tissue, score FROM cells""",
    "file_var": """
    SELECT 'file_' || lpad(k::VARCHAR, 3, '0') AS file, id - (id + 24 - k) // 25 AS col_pos, ensemble_id AS var_id,
           symbol, biotype, id AS source_id
    FROM features, (SELECT unnest(range(25)) AS k) WHERE id % 25 <> k""",
    "file_x": """
    SELECT 'file_' || lpad((cell_id % 25)::VARCHAR, 3, '0') AS file, cell_id // 25 AS row_pos,
           feature_id - (feature_id + 24 - cell_id % 25) // 25 AS col_pos,
           CASE WHEN raw_count % 10 = 0 THEN 0 ELSE raw_count END::DOUBLE AS value
    FROM counts WHERE feature_id % 25 <> cell_id % 25""",
    "blocks": """
    SELECT file, row_number() OVER (ORDER BY file) - 1 AS ingest_id, n_obs, n_vars,
           coalesce(sum(n_obs) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cell_start,
           coalesce(sum(n_vars) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS feature_start
    FROM (SELECT file, count(*) AS n_obs FROM file_obs GROUP BY file)
    JOIN (SELECT file, count(*) AS n_vars FROM file_var GROUP BY file) USING (file)""",
    "faulty_x": """
    SELECT 'file_' || l_returnflag AS file, l_orderkey AS row_pos, l_partkey AS col_pos,
           CASE WHEN l_orderkey % 97 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 89 = 0 THEN -l_quantity
                WHEN l_orderkey % 83 = 0 THEN l_quantity + 0.5 WHEN l_orderkey % 79 = 0 THEN 3e9
                WHEN l_orderkey % 73 = 0 THEN 'inf'::DOUBLE ELSE l_quantity END AS value
    FROM lineitem""",
    "faulty_shapes": """
    SELECT file, max(row_pos) - 10 AS n_obs, max(col_pos) + 1 AS n_vars FROM faulty_x GROUP BY file""",
}


def hash_sql(expression: str, seed: int = 0) -> str:
    """SQL of ``functions.shuffle_hash``."""
    return f"('0x' || substr(md5((({expression}) + {seed})::VARCHAR), 1, 15))::BIGINT"


def with_views(body: str, views: tuple[str, ...]) -> str:
    """``body`` behind the views it names, the listed ones and the views those use."""
    needed, pending = set(), [*views, *(v for v in re.findall(r"\w+", body) if v in VIEWS)]
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += [v for v in VIEWS if v != name and v in re.findall(r"\w+", VIEWS[name])]
    parts = []
    for name, text in VIEWS.items():
        if name in needed:
            for seed in (3, 7):
                text = text.replace(f"{{hash:id:{seed}}}", hash_sql("id", seed))
            parts.append(f"{name} AS ({text})")
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of ``StarTables`` under ``name``, with its SQL where SQL can say it."""

    def register(build: Callable[[StarTables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(StarTables(spark, folder))
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return build

    return register
