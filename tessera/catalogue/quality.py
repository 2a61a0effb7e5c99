"""Data quality: schemas, contracts, metrics, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue.registry import query
from tessera.operators import quality


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'source_type: not one of its values' WHEN doc_id % 5 = 1 THEN 'size_bytes: below 0' ELSE '' END AS errors FROM documents""")
def schema_violations(t):
    rows = t("documents").select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "fax").otherwise("document").alias("source_type"), F.sha2("text", 256).alias("checksum"), F.lit("completed").alias("processing_status"), F.when(F.col("doc_id") % 5 == 1, -1).otherwise(F.length("text")).alias("size_bytes"))
    return rows.select("doc_id", F.array_join(quality.schema_errors(rows, "document"), "; ").alias("errors"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) < 10 THEN 'content:critical' ELSE '' END || CASE WHEN turn % 3 = 1 THEN CASE WHEN length(text) < 10 THEN ';' ELSE '' END || 'parent_type:high' ELSE '' END AS violations FROM conversations""")
def contract_violations(t):
    rows = t("conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("parent_node_id"), F.when(F.col("turn") % 3 == 1, "thing").otherwise("communication").alias("parent_type"), F.col("text").alias("content"), F.col("turn").alias("chunk_index"))
    v = quality.contract_violations(rows, "gold_to_rag")
    order = F.transform(F.filter(v, lambda x: x["field"] != "x"), lambda x: F.concat_ws(":", x["field"], x["severity"]))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(order), ";").alias("violations"))


@query("""SELECT count(*) AS n_rows, round(count_if(text IS NULL) / greatest(count(*), 1), 6) AS text_null_rate, round(count_if(lang IS NULL) / greatest(count(*), 1), 6) AS lang_null_rate, round(count(DISTINCT doc_id) / greatest(count(*), 1), 6) AS doc_id_unique_rate, round(count(DISTINCT text) / greatest(count(*), 1), 6) AS text_unique_rate FROM documents""")
def dataset_quality_metrics(t):
    return quality.dataset_metrics(t("documents"), ["text", "lang"], ["doc_id", "text"])


@query("""SELECT count(*) AS n_rows, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS orphans, round(count(l.doc_id) / greatest(count(*), 1), 6) AS integrity FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def referential_integrity(t):
    return quality.integrity(t("documents"), "doc_id", t("labels"), "doc_id")


@query("""SELECT count(*) AS total, CAST(count_if(len(embedding) = 64) AS BIGINT) AS valid, CAST(count_if(len(embedding) <> 64) AS BIGINT) AS invalid_dim, CAST(0 AS BIGINT) AS corrupt, CAST(count_if(embedding IS NULL) AS BIGINT) AS null_vectors, CASE WHEN count_if(len(embedding) = 64) / greatest(count(*), 1) > 0.9 THEN 'good' ELSE 'degraded' END AS health FROM embeddings""")
def embedding_validation(t):
    return quality.embedding_validation(t("embeddings"), "embedding", 64)


_MOMENTS = "SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE {}) GROUP BY d"


@query(f"""WITH r AS ({_MOMENTS.format("label < 5")}), c AS ({_MOMENTS.format("label >= 5")}),
z AS (SELECT r.m AS rm, c.m AS cm, abs(r.m) / greatest(r.s, 1e-10) AS rz, abs(c.m) / greatest(c.s, 1e-10) AS cz, r.s AS rs FROM r JOIN c USING (d)),
p AS (SELECT sqrt(sum(power(rm - cm, 2))) AS shift, max(CASE WHEN rs <> 0 AND rz <> 0 AND cz <> 0 THEN (cz - rz) * ln(cz / rz) END) AS psi FROM z)
SELECT round(shift, 6) AS mean_shift, round(psi, 6) AS max_psi, shift > 0.1 OR psi > 0.2 AS drift_detected FROM p""")
def embedding_drift_by_label(t):
    e = t("embeddings")
    out = quality.drift(e.filter("label < 5"), e.filter("label >= 5"), "embedding")
    return out.select(F.round("mean_shift", 6).alias("mean_shift"), F.round("max_psi", 6).alias("max_psi"), "drift_detected")


@query("""SELECT round(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02 00:00:00') / 3600, 4) AS age_hours, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02 00:00:00') / 3600 > 24 AS stale FROM events""")
def freshness(t):
    return quality.freshness(t("events"), "ts", "2024-02-02 00:00:00")
