"""Registered queries with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cairnmap.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with_package(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf)

    return run


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = _with_package(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Views used by the SQL twins, in dependency order; the twin of each function in inputs.py.
_VIEWS = {
    "rows_": """SELECT doc_id AS row_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'doc-' || doc_id END AS row_name,
        lang, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, CAST(n_chars AS VARCHAR) AS n_chars, text
        FROM documents""",
    "built_": """SELECT row_id AS item_id, row_name, lang, source, n_chars,
        concat_ws(chr(10) || chr(10), nullif(row_name, ''),
            nullif(concat_ws(', ', 'lang: ' || nullif(lang, ''), 'source: ' || nullif(source, ''), 'n_chars: ' || nullif(n_chars, '')), ''),
            nullif(text, '')) AS text FROM rows_""",
    "reps_": "SELECT item_id, text FROM built_ WHERE trim(text) <> ''",
    "vec_": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "asg_vec_": """SELECT 1 AS cluster_run_id, vec_id AS item_id,
        CAST(CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS BIGINT) AS cluster_id,
        CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE 1.0 END AS membership_probability FROM embeddings""",
    "asg_doc_": """SELECT 2 AS cluster_run_id, doc_id AS item_id, n_chars % 13 - 1 AS cluster_id,
        1.0 AS membership_probability FROM documents""",
    "asg_ord_": """SELECT o_custkey % 25 + 1 AS cluster_run_id, o_orderkey AS item_id,
        (o_custkey // 25) % 40 - 1 AS cluster_id, round(o_totalprice / 1000000, 4) AS membership_probability FROM orders""",
    "runs_": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS cluster_run_id, CAST(n_regionkey AS BIGINT) AS reduction_id,
        CASE WHEN n_nationkey % 2 = 0 THEN 'hdbscan' ELSE 'agglomerative' END AS method,
        '{"k": ' || n_nationkey || '}' AS params FROM nation
        UNION ALL SELECT CAST(r_regionkey + 26 AS BIGINT), CAST(r_regionkey AS BIGINT), 'merged',
        '{"model": "m' || (r_regionkey % 2) || '", "parent_cluster_run_id": 1, "provider": "p"}' FROM region""",
    "sums_": """SELECT c_custkey AS cluster_summary_id, c_custkey % 25 + 1 AS cluster_run_id,
        (c_custkey // 25) % 40 - 1 AS cluster_id, CASE WHEN c_custkey % 2 = 0 THEN 'p0' ELSE 'p1' END AS provider,
        'm' || (c_custkey % 3) AS model, c_mktsegment || ' ' || c_nationkey AS label,
        CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS short_label, c_name AS rationale,
        c_mktsegment || ', n' || c_nationkey AS keywords, c_custkey % 625 = 24 AS reconciled FROM customer""",
    "latest_": """SELECT * FROM sums_ QUALIFY row_number() OVER (
        PARTITION BY cluster_run_id, cluster_id ORDER BY cluster_summary_id DESC) = 1""",
    "sizes_ord_": """SELECT cluster_run_id, cluster_id, count(*) AS size FROM asg_ord_ WHERE cluster_id >= 0
        GROUP BY 1, 2""",
    "dec_": """SELECT c_custkey % 25 + 1 AS cluster_run_id, CAST(c_nationkey % ((c_custkey % 25 + 1) % 6 + 1) AS BIGINT) AS group_no,
        c_custkey AS pos, (c_custkey // 25) % 44 - 1 AS cluster_id, c_name AS rationale FROM customer""",
    "first_use_": """SELECT d.* FROM dec_ d SEMI JOIN sizes_ord_ USING (cluster_run_id, cluster_id)
        QUALIFY row_number() OVER (PARTITION BY d.cluster_run_id, d.cluster_id ORDER BY group_no, pos) = 1""",
    "groups_": """SELECT cluster_run_id, group_no, count(*) AS n, min(cluster_id) AS anchor, max(rationale) AS rationale,
        string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) AS cluster_ids
        FROM (SELECT cluster_run_id, group_no, cluster_id,
            min_by(rationale, pos) OVER (PARTITION BY cluster_run_id, group_no) AS rationale FROM first_use_)
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "kept_": """SELECT g.* FROM groups_ g JOIN (SELECT cluster_run_id, count(*) AS total FROM sizes_ord_ GROUP BY 1) t USING (cluster_run_id)
        QUALIFY total - sum(n - 1) OVER (PARTITION BY cluster_run_id ORDER BY n DESC, group_no
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 2""",
    "map_": """SELECT cluster_run_id, cluster_id, CAST(dense_rank() OVER (PARTITION BY cluster_run_id ORDER BY root) - 1 AS BIGINT) AS new_cluster_id
        FROM (SELECT s.cluster_run_id, s.cluster_id, coalesce(k.anchor, s.cluster_id) AS root FROM sizes_ord_ s
            LEFT JOIN first_use_ f USING (cluster_run_id, cluster_id)
            LEFT JOIN kept_ k ON k.cluster_run_id = s.cluster_run_id AND k.group_no = f.group_no)""",
    "nodes_": """SELECT n AS node_index, CAST(n // 4 AS INTEGER) AS grid_i, CAST(n % 4 AS INTEGER) AS grid_j,
        list(x ORDER BY pos) AS weight
        FROM (SELECT item_id % 16 AS n, pos, avg(x) AS x FROM (
            SELECT item_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec_) GROUP BY 1, 2) GROUP BY 1""",
    "bmu_": """SELECT item_id, node_index, grid_i, grid_j FROM (
        SELECT item_id, node_index, grid_i, grid_j,
            row_number() OVER (PARTITION BY item_id ORDER BY round(list_distance(v, weight), 9), node_index) AS r
        FROM vec_, nodes_) WHERE r = 1""",
    "files_": """SELECT page_id AS item_id,
        '/files/p' || page_id || (['.html', '.txt', '.png', '.JPG', '.tar.gz', ''])[page_id % 6 + 1] AS original_path,
        html AS content FROM pages""",
    "links_": "SELECT item_id, original_path, sha256(content) AS artifact_id, CAST(strlen(content) AS BIGINT) AS bytes FROM files_",
    "mimed_": """SELECT *, CASE page_id_mod WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png'
        WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'application/x-tar' END AS mime_type,
        CASE page_id_mod WHEN 0 THEN '.html' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' WHEN 3 THEN '.JPG' WHEN 4 THEN '.gz' ELSE '' END AS ext
        FROM (SELECT *, item_id % 6 AS page_id_mod FROM links_)""",
    "arts_": """SELECT artifact_id, original_path, artifact_id[1:2] || '/' || artifact_id || ext AS stored_path, mime_type, bytes
        FROM mimed_ QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY item_id) = 1""",
    "reds_": """SELECT p_partkey AS reduction_id, p_brand AS embedding_reference,
        CASE p_partkey % 3 WHEN 0 THEN 'pca' WHEN 1 THEN 'umap' ELSE 'som' END AS method,
        CAST(CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE p_size % 4 + 1 END AS INTEGER) AS target_dimensions,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS grid, 'f' || (p_size % 7) AS fingerprint FROM part""",
    "crits_": """SELECT s_suppkey AS critique_id, s_suppkey % 30 + 1 AS cluster_run_id,
        CASE WHEN s_suppkey % 2 = 0 THEN 'p0' ELSE 'p1' END AS provider, 'm0' AS model, s_name AS verdict,
        round(abs(s_acctbal) / 10000, 3) AS quality_score FROM supplier""",
}

# Views each view reads.
_NEEDS = {
    "built_": ["rows_"], "reps_": ["built_"], "latest_": ["sums_"], "sizes_ord_": ["asg_ord_"],
    "first_use_": ["dec_", "sizes_ord_"], "groups_": ["first_use_"], "kept_": ["groups_", "sizes_ord_"],
    "map_": ["sizes_ord_", "first_use_", "kept_"], "nodes_": ["vec_"], "bmu_": ["vec_", "nodes_"],
    "links_": ["files_"], "mimed_": ["links_"], "arts_": ["mimed_"],
}


def over(*views: str, sql: str) -> str:
    """The statement with the views it needs put in front."""
    wanted: set[str] = set()
    stack = list(views)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack.extend(_NEEDS.get(name, []))
    parts = [f"{name} AS ({body})" for name, body in _VIEWS.items() if name in wanted]
    return f"WITH {', '.join(parts)} {sql}"
