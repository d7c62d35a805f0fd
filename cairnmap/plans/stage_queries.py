"""Registered queries: rows, files, texts, labels and prompts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cairnmap.functions import prompts, text as X, vectors as V
from cairnmap.functions.ranking import top_per_group
from cairnmap.operators import embed, exemplars, generate, labels, materialize, metrics, sampling
from cairnmap.plans import inputs as I
from cairnmap.plans.catalog import over, query
from cairnmap.sources import artifacts, csv_rows

_LABEL = "label string, short_label string, rationale string, keywords array<string>"


@query("items", "SELECT doc_id AS item_id, doc_id AS row_id FROM documents")
def items(spark, sf):
    return csv_rows.items(I.rows(spark, sf))


@query("row_metadata", over("rows_", sql="""
    SELECT row_id, row_name, unnest(['lang', 'source', 'n_chars']) AS key, unnest([lang, source, n_chars]) AS value FROM rows_"""))
def row_metadata(spark, sf):
    return I.rows(spark, sf).select("row_id", "row_name", F.explode("metadata").alias("key", "value"))


@query("artifacts", over("arts_", sql="SELECT * FROM arts_"))
def artifact_table(spark, sf):
    return artifacts.artifacts(artifacts.addressed(I.page_files(spark, sf)))


@query("artifact_links", over("links_", sql="SELECT DISTINCT item_id, artifact_id, 'source' AS role FROM links_"))
def artifact_links(spark, sf):
    return artifacts.item_artifacts(artifacts.addressed(I.page_files(spark, sf)))


@query("attached_files", over("links_", sql="""
    SELECT item_id, original_path, artifact_id, bytes FROM links_ WHERE item_id % 3 <> 0"""))
def attached_files(spark, sf):
    """Rows that name a page by its absolute or relative path; every third names none."""
    files = I.page_files(spark, sf)
    relative = F.regexp_replace("original_path", "^/files/", "")
    named = files.select(
        F.col("item_id").alias("row_id"), "source_row_number",
        F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.concat(F.lit("./"), relative))
        .otherwise(F.col("original_path")).alias("file_path"),
    )
    listed = files.select(F.col("original_path").alias("path"), relative.alias("relative"), "content")
    return artifacts.attach(named, listed).select("item_id", "original_path", "artifact_id", "bytes")


@query("file_text", """
    SELECT page_id AS item_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS text FROM pages""")
def file_text(spark, sf):
    broken = F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8")))
    content = broken.otherwise(F.encode("html", "UTF-8"))
    return I.table(spark, sf, "pages").select(
        F.col("page_id").alias("item_id"), artifacts.file_text(content).alias("text")
    )


@query("artifact_texts", r"""
    SELECT conv_id AS item_id, string_agg(t, chr(10) || chr(10) ORDER BY lpad(CAST(turn AS VARCHAR), 6, '0')) AS extracted_text
    FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY 1""")
def artifact_texts(spark, sf):
    parts = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("artifact_id"), "text"
    )
    return artifacts.item_texts(parts)


@query("embedding_text", over("built_", sql="SELECT item_id, text FROM built_"))
def embedding_text(spark, sf):
    return I.representations(spark, sf).select("item_id", "text")


@query("text_hash", over("built_", sql="SELECT item_id, sha256(text) AS text_hash FROM built_"))
def text_hash(spark, sf):
    return I.representations(spark, sf).select("item_id", "text_hash")


@query("fallback_text", over("files_", sql=r"""
    SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'page ' || item_id
        ELSE 'p' || item_id || CASE WHEN item_id % 6 = 4 THEN '.tar' ELSE '' END END AS text FROM files_"""))
def fallback_text(spark, sf):
    files = I.page_files(spark, sf)
    rows = files.select(
        F.col("item_id").alias("row_id"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("page "), F.col("item_id"))).otherwise(" ").alias("row_name"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return materialize.representations(rows, None, files.select("item_id", "original_path")).select("item_id", "text")


@query("pending_items", over("rows_", sql="SELECT row_id FROM rows_ WHERE row_id NOT IN (SELECT doc_id FROM labels)"))
def pending_items(spark, sf):
    done = I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("embedding_text").alias("representation_type")
    )
    return materialize.pending_items(I.rows(spark, sf), done).select("row_id")


def _reps_of_pages(spark, sf):
    return I.table(spark, sf, "pages").select(
        F.col("page_id").alias("representation_id"), F.col("page_id").alias("item_id"),
        F.lit("embedding_text").alias("representation_type"), F.col("html").alias("text"),
    )


def _embedded(spark, sf):
    return I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("representation_id"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("model_name")
    )


@query("pending_text", over("arts_", sql="""
    SELECT item_id FROM links_ WHERE item_id NOT IN (
        SELECT l.item_id FROM links_ l JOIN arts_ a USING (artifact_id) WHERE a.mime_type LIKE 'image/%')
    AND item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def pending_text(spark, sf):
    links = artifacts.addressed(I.page_files(spark, sf))
    return materialize.pending_text(
        _reps_of_pages(spark, sf), links, artifacts.artifacts(links), _embedded(spark, sf), "a"
    ).select("item_id")


@query("pending_images", over("arts_", sql="""
    SELECT l.item_id, min(a.stored_path) AS stored_path FROM links_ l JOIN arts_ a USING (artifact_id)
    WHERE a.mime_type LIKE 'image/%' AND l.item_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 1) GROUP BY 1"""))
def pending_images(spark, sf):
    links = artifacts.addressed(I.page_files(spark, sf))
    return materialize.pending_images(
        _reps_of_pages(spark, sf), links, artifacts.artifacts(links), _embedded(spark, sf), "b"
    ).select("item_id", "stored_path")


@query("token_budget", r"""
    SELECT doc_id, 'clustering: ' || CASE WHEN len(w) > 49 THEN array_to_string(w[1:49], ' ') ELSE text END AS text
    FROM (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents)""")
def token_budget(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", X.within_budget(F.col("text"), 50, "clustering: ").alias("text")
    )


@query("clipped_text", "SELECT doc_id, substr(text, 1, 500) AS text FROM documents")
def clipped_text(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 500).alias("text"))


@query("normalized_text", r"""
    SELECT * FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents) WHERE text <> ''""")
def normalized_text(spark, sf):
    clean = I.table(spark, sf, "documents").select("doc_id", X.normalize_blanks(F.col("text")).alias("text"))
    return clean.filter(F.col("text") != "")


@query("l2_normalize", over("vec_", sql="""
    SELECT item_id, pos, round(x * (item_id % 5) / greatest(sqrt(sum(x * x * (item_id % 5) * (item_id % 5)) OVER (PARTITION BY item_id)), 1e-12), 6) AS x
    FROM (SELECT item_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM vec_)"""))
def l2_normalize(spark, sf):
    scaled = F.transform(V.as_doubles(F.col("vector")), lambda x: x * (F.col("item_id") % 5))
    return I.vectors(spark, sf).select("item_id", F.posexplode(V.l2_normalize(scaled)).alias("pos", "x")).select(
        "item_id", "pos", F.round("x", 6).alias("x")
    )


@query("nan_guard", over("vec_", sql="""
    SELECT item_id, round(CASE WHEN item_id % 10 = 3 THEN 0 ELSE list_sum(v) END, 6) AS total, len(v) AS width FROM vec_"""))
def nan_guard(spark, sf):
    spoiled = I.vectors(spark, sf).select("item_id", F.when(
        F.col("item_id") % 10 == 3, F.transform(V.as_doubles(F.col("vector")), lambda x, i: F.when(i == 5, float("nan")).otherwise(x))
    ).otherwise(V.as_doubles(F.col("vector"))).alias("vector"))
    fixed = spoiled.select("item_id", V.zero_if_nan(F.col("vector")).alias("v"))
    return fixed.select("item_id", F.round(V.total(F.col("v")), 6).alias("total"), F.size("v").cast("long").alias("width"))


@query("embed_summary", """
    SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS model_name, count(*) AS embedded,
        max(len(embedding)) AS dimensions, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS zero_vectors
    FROM embeddings GROUP BY 1""")
def embed_summary(spark, sf):
    stored = I.table(spark, sf, "embeddings").select(
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model_name"),
        F.size("embedding").cast("long").alias("dimensions"), F.col("embedding").alias("vector"),
    )
    return embed.embed_summary(stored)


@query("embed_hashed")
def embed_hashed(spark, sf):
    pending = I.representations(spark, sf).select("representation_id", "item_id", "text")
    return embed.embed_hashed(pending).select(
        "item_id", "model_name", "dimensions", F.round(V.l2_norm(F.col("vector")), 4).alias("length")
    )


def _letter_shares(values):
    out = np.zeros((len(values), 26))
    for row, value in enumerate(values):
        raw = value.lower().encode() if isinstance(value, str) else bytes(value).lower()
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[97:123]
        out[row] = counts
    return out


def _components(embedded):
    return embedded.select("item_id", "model_name", "dimensions", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


def _letters_sql(view: str, content: str) -> str:
    return over(view, sql=f"""
    , t_ AS MATERIALIZED (SELECT item_id, {content} AS t FROM {view}),
    n_ AS (SELECT item_id, CAST(p AS INTEGER) AS pos, strlen(t) - strlen(replace(replace(t, chr(97 + p::INT), ''), chr(65 + p::INT), '')) AS n
        FROM t_, range(26) r(p))
    SELECT item_id, 'letters' AS model_name, 26 AS dimensions, pos,
        round(CAST(CAST(n / greatest(sqrt(sum(n * n) OVER (PARTITION BY item_id)), 1e-12) AS FLOAT) AS DOUBLE), 5) AS x FROM n_""")


_BUDGETED = rf"""'{embed.TASK_PREFIX}' || CASE WHEN len(string_split_regex(trim(text), '\s+')) >= {embed.MAX_TOKENS}
        THEN array_to_string(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:{embed.MAX_TOKENS - 1}], ' ') ELSE text END"""


@query("embed_texts", _letters_sql("reps_", _BUDGETED))
def embed_texts(spark, sf):
    pending = I.representations(spark, sf).select("representation_id", "item_id", "text")
    return _components(embed.embed_texts(pending, _letter_shares, "letters"))


@query("embed_files", _letters_sql("files_", "content"))
def embed_files(spark, sf):
    files = I.page_files(spark, sf).withColumn("representation_id", F.col("item_id"))
    return _components(embed.embed(files, "content", _letter_shares, "letters"))


def _byte_counts(values):
    if any(len(v) % 7 == 0 for v in values):
        raise ValueError("refused")
    return [f"{len(v)} bytes" for v in values]


@query("describe_files", over("links_", sql="""
    SELECT DISTINCT artifact_id, CASE WHEN bytes % 7 = 0 THEN '' ELSE bytes || ' bytes' END AS text FROM links_"""))
def describe_files(spark, sf):
    files = I.page_files(spark, sf).withColumn("artifact_id", F.sha2("content", 256))
    return materialize.describe(files, _byte_counts)


@query("stratified_sample", """
    SELECT lang, doc_id, CAST(rank AS BIGINT) AS rank FROM (
        SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank
        FROM documents) WHERE rank <= 50""")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(I.table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("strata_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def strata_counts(spark, sf):
    return sampling.strata_counts(I.table(spark, sf, "documents"), "lang")


_SCORED = """
    m_ AS (SELECT a.cluster_run_id, a.cluster_id, item_id, pos, x,
        x / (sqrt(sum(x * x) OVER (PARTITION BY item_id)) + 1e-10) AS u
        FROM asg_vec_ a JOIN (SELECT item_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec_) USING (item_id)
        WHERE cluster_id >= 0),
    c0_ AS (SELECT cluster_id, pos, avg(x) AS c, avg(u) AS d FROM m_ GROUP BY 1, 2),
    c_ AS (SELECT cluster_id, pos, d, c / (sqrt(sum(c * c) OVER (PARTITION BY cluster_id)) + 1e-10) AS c FROM c0_),
    s_ AS (SELECT cluster_run_id, cluster_id, item_id, sum(u * c) AS centroid_similarity,
        sum(u * d) AS mean_similarity FROM m_ JOIN c_ USING (cluster_id, pos) GROUP BY 1, 2, 3)"""

_PICKS = """,
    near_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(centroid_similarity, 9) DESC, item_id) AS near FROM s_) WHERE near <= 20),
    centre_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(mean_similarity, 9) DESC, near) AS rank FROM near_) WHERE rank <= 3),
    edge_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(centroid_similarity, 9), item_id) AS rank
        FROM s_ WHERE item_id NOT IN (SELECT item_id FROM centre_)) WHERE rank <= 2),
    picks_ AS (SELECT cluster_run_id, cluster_id, item_id, 'center' AS kind, rank, mean_similarity AS score FROM centre_
        UNION ALL SELECT cluster_run_id, cluster_id, item_id, 'outskirt', rank, centroid_similarity FROM edge_)"""


def _exemplar_sql(tail: str, picks: bool = True, *views: str) -> str:
    return over("asg_vec_", "vec_", *views, sql=f", {_SCORED}{_PICKS if picks else ''} {tail}")


@query("cluster_centroids", _exemplar_sql(
    "SELECT cluster_id, CAST(pos - 1 AS INTEGER) AS pos, round(c, 6) AS x FROM c0_", False))
def cluster_centroids(spark, sf):
    found = exemplars.centroids(exemplars.members(I.vector_assignments(spark, sf), I.vectors(spark, sf)))
    return found.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select(
        "cluster_id", "pos", F.round("x", 6).alias("x")
    )


@query("centroid_similarity", _exemplar_sql(
    "SELECT cluster_id, item_id, round(centroid_similarity, 6) AS centroid_similarity, round(mean_similarity, 6) AS mean_similarity FROM s_", False))
def centroid_similarity(spark, sf):
    scored = exemplars.similarities(exemplars.members(I.vector_assignments(spark, sf), I.vectors(spark, sf)))
    return scored.select(
        "cluster_id", "item_id", F.round("centroid_similarity", 6).alias("centroid_similarity"),
        F.round("mean_similarity", 6).alias("mean_similarity"),
    )


@query("exemplars", _exemplar_sql("SELECT cluster_id, item_id, kind, rank, round(score, 6) AS score FROM picks_"))
def select_exemplars(spark, sf):
    picked = exemplars.select_exemplars(I.vector_assignments(spark, sf), I.vectors(spark, sf))
    return picked.select("cluster_id", "item_id", "kind", "rank", F.round("score", 6).alias("score"))


@query("exemplar_sections", _exemplar_sql(r"""
    , t_ AS (SELECT cluster_id, kind, rank, substr(text, 1, 500) AS text,
        row_number() OVER (PARTITION BY cluster_id, kind ORDER BY rank) AS i FROM picks_ JOIN reps_ USING (item_id)),
    sec_ AS (SELECT cluster_id, kind,
        CASE kind WHEN 'center' THEN 'Most typical members:' ELSE 'Members near the edges:' END || chr(10) ||
        string_agg('[' || CASE kind WHEN 'center' THEN 'Central' ELSE 'Outskirts' END || ' example ' || i || ']' || chr(10) || text,
            chr(10) || '---' || chr(10) ORDER BY i) AS s FROM t_ GROUP BY 1, 2)
    SELECT cluster_id, string_agg(s, chr(10) || chr(10) ORDER BY kind) AS sections FROM sec_ GROUP BY 1""", True, "reps_"))
def exemplar_sections(spark, sf):
    picked = exemplars.select_exemplars(I.vector_assignments(spark, sf), I.vectors(spark, sf))
    return prompts.exemplar_sections(picked, I.representations(spark, sf)).select("cluster_id", "sections")


@query("label_prompts", over("asg_doc_", "reps_", sql=f"""
    SELECT cluster_id, size, replace(replace('{prompts.LABEL_REQUEST.replace("%s", "@1", 1).replace("%s", "@2", 1)}', '@1', CAST(size AS VARCHAR)), '@2',
        'Most typical members:' || chr(10) || body) AS prompt
    FROM (SELECT a.cluster_id, string_agg('[Central example ' || i || ']' || chr(10) || substr(text, 1, 500), chr(10) || '---' || chr(10) ORDER BY i) AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS i FROM asg_doc_) a
        JOIN reps_ USING (item_id) WHERE i <= 3 GROUP BY 1)
    JOIN (SELECT cluster_id, count(*) AS size FROM asg_doc_ WHERE cluster_id >= 0 GROUP BY 1) USING (cluster_id)"""))
def label_prompts(spark, sf):
    assigned = I.document_assignments(spark, sf)
    picked = top_per_group(assigned, ["cluster_run_id", "cluster_id"], [F.col("item_id")], 3).withColumn("kind", F.lit("center"))
    sections = prompts.exemplar_sections(picked, I.representations(spark, sf))
    return prompts.label_prompts(sections, metrics.cluster_sizes(assigned)).select("cluster_id", "size", "prompt")


@query("cluster_keywords", over("asg_doc_", sql=r"""
    , w_ AS (SELECT cluster_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term
        FROM asg_doc_ JOIN documents ON doc_id = item_id WHERE cluster_id >= 0),
    n_ AS (SELECT cluster_id, term, count(*) AS n FROM w_ WHERE length(term) >= 3 GROUP BY 1, 2),
    c_ AS (SELECT cluster_id, sum(n) AS cw FROM n_ GROUP BY 1),
    t_ AS (SELECT term, sum(n) AS tw FROM n_ GROUP BY 1),
    s_ AS (SELECT cluster_id, term, n / cw * ln(1 + (SELECT avg(cw) FROM c_) / tw) AS score FROM n_ JOIN c_ USING (cluster_id) JOIN t_ USING (term))
    SELECT cluster_id, term, round(score, 7) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term) AS rank FROM s_) WHERE rank <= 5"""))
def cluster_keywords(spark, sf):
    found = labels.cluster_keywords(I.document_assignments(spark, sf), I.plain_texts(spark, sf))
    return found.select("cluster_id", "term", F.round("score", 7).alias("score"), "rank")


@query("offline_labels", over("asg_doc_", sql=r"""
    , w_ AS (SELECT cluster_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term
        FROM asg_doc_ JOIN documents ON doc_id = item_id WHERE cluster_id >= 0),
    n_ AS (SELECT cluster_id, term, count(*) AS n FROM w_ WHERE length(term) >= 3 GROUP BY 1, 2),
    c_ AS (SELECT cluster_id, sum(n) AS cw FROM n_ GROUP BY 1),
    t_ AS (SELECT term, sum(n) AS tw FROM n_ GROUP BY 1),
    r_ AS (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY round(n / cw * ln(1 + (SELECT avg(cw) FROM c_) / tw), 9) DESC, term) AS rank
        FROM n_ JOIN c_ USING (cluster_id) JOIN t_ USING (term))
    SELECT CAST(2 AS BIGINT) AS cluster_run_id, cluster_id, string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 3) AS label, min_by(term, rank) AS short_label,
        'Most distinctive words: ' || string_agg(term, ', ' ORDER BY rank) AS rationale, string_agg(term, ', ' ORDER BY rank) AS keywords
    FROM r_ WHERE rank <= 5 GROUP BY cluster_id"""))
def offline_labels(spark, sf):
    found = labels.cluster_keywords(I.document_assignments(spark, sf), I.plain_texts(spark, sf))
    return labels.offline_labels(found).withColumn("keywords", F.array_join("keywords", ", "))


@query("parse_replies", """
    SELECT doc_id AS request_id, CASE WHEN doc_id % 6 < 4 THEN lang END AS label, CASE WHEN doc_id % 6 < 4 THEN source END AS short_label,
        CASE WHEN doc_id % 6 < 4 THEN text END AS rationale, CASE WHEN doc_id % 6 < 4 THEN lang || ', ' || source END AS keywords,
        doc_id % 6 < 4 AS valid FROM documents""")
def parse_replies(spark, sf):
    parsed = I.replies(spark, sf).select("request_id", generate.parse_reply(F.col("raw_text"), _LABEL).alias("r"))
    return parsed.select(
        "request_id", "r.label", "r.short_label", "r.rationale", F.array_join("r.keywords", ", ").alias("keywords"),
        F.col("r").isNotNull().alias("valid"),
    )


def _echo(batch):
    """Stands in for a model: the reply to a prompt is the prompt's own JSON, cut off for some."""
    return batch


@query("model_attempts", """
    SELECT CAST(doc_id AS VARCHAR) AS request_id, a AS attempt, doc_id % 6 < 4 AS valid FROM documents,
        (SELECT unnest([1, 2, 3]) AS a) WHERE a = 1 OR doc_id % 6 >= 4""")
def model_attempts(spark, sf):
    requests = I.replies(spark, sf).withColumnRenamed("raw_text", "prompt")
    tries = generate.attempts(requests, _echo, _LABEL)
    return tries.select("request_id", "attempt", F.col("parsed").isNotNull().alias("valid"))
