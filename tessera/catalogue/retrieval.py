"""Search and retrieval on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue.registry import query
from tessera.functions import enrich, vectors
from tessera.operators import fulltext, latent, relational, search, vector_index
from tessera.plans import api

#: A fixed query vector of 64 dimensions.
QUERY = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_Q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY) + "]"
_COS = f"round(list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({_Q}, {_Q}))), 6)"


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk(t):
    rows = t("embeddings").withColumn("score", F.round(vectors.cosine_to(F.col("embedding"), QUERY), 6))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


_UNIT = """WITH v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),"""


@query(_UNIT + """
s AS (SELECT q.vec_id AS query, v.vec_id AS key, round(list_dot_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0)
SELECT query, key, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 10""")
def vector_index_exact(t):
    """Every vector whose id is divisible by 50 against all, from a new index; cells that can't hold a neighbour
    aren't read."""
    rows = t("embeddings")
    made = vector_index.VectorIndex.build(rows, "vec_id", "embedding", vector_index.new_folder(rows.sparkSession), 64, cells=32)
    hits = made.search(rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", most=10, exact=True, digits=6)
    return hits.select("query", "key", "score", "rank")


@query()
def latent_vectors(t):
    """Vectors of all documents in 64 dimensions that the documents themselves teach."""
    docs = t("documents").select("doc_id", "text")
    found = latent.Latent.fitted(docs, "text", 64).embedded(docs, "text")
    return found.select("doc_id", F.transform("embedding_vector", lambda x: F.round(x, 4)).alias("embedding_vector"))


@query()
def vector_index_topk(t):
    """The same searches by codes, with an exact rerank; see the test of their recall."""
    rows = t("embeddings")
    made = vector_index.VectorIndex.build(rows, "vec_id", "embedding", vector_index.new_folder(rows.sparkSession), 64, cells=32)
    return made.search(rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", most=10, probes=16, rerank=100)


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE {_COS} > 0.1")
def cosine_threshold(t):
    rows = t("embeddings").withColumn("score", F.round(vectors.cosine_to(F.col("embedding"), QUERY), 6))
    return rows.filter("score > 0.1").select("vec_id", "score")


@query("""SELECT doc_id, length(text) AS chars FROM documents WHERE text ILIKE '%worthless%' OR source ILIKE '%worthless%' OR text ILIKE '%idiot%' OR source ILIKE '%idiot%' ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 10""", longs=("chars",))
def keyword_search_ilike(t):
    docs = t("documents").withColumn("chars", F.length("text"))
    return search.keyword_search(docs, "worthless idiot?", ["text", "source"], [F.desc_nulls_last("chars"), F.asc("doc_id")]).select("doc_id", "chars")


@query(r"""SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), ['the', 'worthless'])""")
def fts_simple_and(t):
    return t("documents").filter(search.has_all(F.col("text"), "The worthless")).select("doc_id")


def _ranked_sql(terms: dict[str, str], most: int) -> str:
    """The rank by distances of two terms, each a pattern of its word forms, pair by pair of positions."""
    a, b = terms.values()
    share = "CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END"
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM w),
d AS (SELECT a.doc_id, abs(a.p - b.p) AS d FROM t a JOIN t b USING (doc_id) WHERE regexp_full_match(a.w, '{a}') AND regexp_full_match(b.w, '{b}'))
SELECT doc_id, round(1 - exp(sum(ln(1 - 0.1 * sqrt({share})))), 6) AS score FROM d WHERE d > 0 GROUP BY doc_id
ORDER BY round(1 - exp(sum(ln(1 - 0.1 * sqrt({share})))), 9) DESC, doc_id LIMIT {most}"""


@query(_ranked_sql({"worthless": "worthless(ly|ness)?", "idiot": "idiots?"}, 10))
def fts_english_topk(t):
    """The best documents of two words, of which one is a stop-word, from new postings."""
    docs = t("documents")
    index = fulltext.PostingsIndex(docs.sparkSession, vector_index.new_folder(docs.sparkSession, "postings"))
    index.insert(docs, "doc_id", "text")
    return index.search("the worthless idiots", 10).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id AS id, {_COS} AS v FROM embeddings ORDER BY v DESC, id LIMIT 20),
k AS (SELECT doc_id AS id, round(1.0 * len(regexp_extract_all(lower(text), 'the')) / length(text), 6) AS k FROM documents ORDER BY k DESC, id LIMIT 20)
SELECT id, round(coalesce(v, 0.0) * 0.7 + coalesce(k, 0.0) * 0.3, 6) AS score, v IS NOT NULL AND k IS NOT NULL AS hybrid FROM v FULL OUTER JOIN k USING (id) ORDER BY score DESC, id LIMIT 10""")
def hybrid_fusion(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.cosine_to(F.col("embedding"), QUERY), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    k = t("documents").select(F.col("doc_id").alias("id"), F.round(F.regexp_count(F.lower("text"), F.lit("the")) / F.length("text"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return search.hybrid(v, k, "id", 10).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id")


@query("""WITH h AS (SELECT conv_id AS id, turn AS seq, CASE role WHEN 'user' THEN 'event' WHEN 'assistant' THEN 'communication' ELSE 'document' END AS type, substr(text, 1, 30) AS summary FROM conversations),
f AS (SELECT id, arg_min(type, seq) AS type, arg_min(summary, seq) AS name, min(seq) AS seq FROM h GROUP BY id)
SELECT id, type, name FROM f ORDER BY CASE type WHEN 'event' THEN 0 WHEN 'document' THEN 1 WHEN 'communication' THEN 2 ELSE 9 END, seq * 10000000000 + id LIMIT 10""")
def source_ranking(t):
    kind = F.when(F.col("role") == "user", "event").when(F.col("role") == "assistant", "communication").otherwise("document")
    rows = t("conversations").select((F.col("turn") * 10000000000 + F.col("conv_id")).alias("seq"), F.col("conv_id").alias("id"), kind.alias("type"), F.lit("").alias("name"), F.substring("text", 1, 30).alias("summary"), F.lit("").alias("content"))
    return search.sources(rows).select("id", "type", "name")


@query("""SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-10' - INTERVAL 7 DAY AND TIMESTAMP '1996-01-10' + INTERVAL 30 DAY ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def recent_window_context(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_orderdate").alias("effective_start"))
    return search.upcoming(rows, "1996-01-10 00:00:00").select("id", "o_totalprice")


@query("""SELECT round(count(DISTINCT label) / greatest(count(*), 1), 6) AS diversity FROM embeddings""")
def retrieval_diversity(t):
    return search.diversity(t("embeddings"), "label").withColumn("diversity", F.round("diversity", 6))


@query("""WITH s AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS src, max(CASE WHEN turn = 1 THEN text END) AS resp FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(resp), '\\s+'), lambda x: x <> '')), lambda x: NOT list_contains(['the','a','an','is','are','was','were','in','on','at','to','for','of','with','by','and','or','but','not'], x)) AS c,
list_filter(regexp_split_to_array(lower(src), '\\s+'), lambda x: x <> '') AS q FROM s WHERE resp IS NOT NULL)
SELECT conv_id, CASE WHEN len(c) = 0 THEN 0.5 ELSE round(1 - len(list_filter(c, lambda x: list_contains(q, x))) / len(c), 6) END AS attribution FROM w""")
def attribution_score(t):
    c = t("conversations")
    both = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("src"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("resp")).filter("resp is not null")
    return both.select("conv_id", enrich.attribution_score(F.col("resp"), F.array("src")).alias("attribution"))


@query(r"""WITH s AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS src, max(CASE WHEN turn = 1 THEN text END) AS resp FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, src, lower(resp) AS r, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(resp), '\s+'), lambda x: x <> '')), lambda x: NOT list_contains(['the','a','an','is','are','was','were','in','on','at','to','for','of','with','by','and','or','but','not'], x)) AS c,
list_filter(regexp_split_to_array(lower(src), '\s+'), lambda x: x <> '') AS q,
list_distinct(list_transform(regexp_extract_all(regexp_replace(resp, '([\p{L}\p{M}\p{N}\p{Pc}]+)', '<\1>', 'g'), '<[A-Z][a-z]+>(?:[\t-\r\x{85}\p{Z}]+<[A-Z][a-z]+>)*'), lambda x: translate(x, '<>', ''))) AS p FROM s WHERE resp IS NOT NULL),
x AS (SELECT conv_id, CASE WHEN len(c) = 0 THEN 0.5 ELSE round(1 - len(list_filter(c, lambda x: list_contains(q, x))) / len(c), 6) END AS a,
CASE WHEN len(p) = 0 THEN 0.0 ELSE round(len(list_filter(p, lambda x: NOT contains(lower(src), lower(x)))) / len(p), 6) END AS g,
least((CAST(regexp_matches(r, 'however|but|actually|contrary to|unlike') AS INT) + CAST(regexp_matches(r, 'no|not|never|none') AS INT) + 2 * CAST(contains(r, ' is not ') AND len(list_filter(string_split(r, ' is not '), lambda x: contains(lower(src), x))) > 0 AS INT)) / 5, 1.0) AS k FROM w)
SELECT conv_id, a AS attribution, g AS entity_grounding, k AS contradiction, round(a * 0.4 + g * 0.3 + k * 0.3, 4) AS overall, round(a * 0.4 + g * 0.3 + k * 0.3, 4) > 0.5 AS flagged FROM x""")
def response_scores(t):
    c = t("conversations")
    both = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("src"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("resp")).filter("resp is not null")
    return both.select("conv_id", enrich.response_scores(F.col("resp"), F.array("src"), F.array("src")).alias("s")).select("conv_id", "s.*")


@query("""WITH h AS (SELECT label AS q, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), g AS (SELECT label AS q, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0),
m AS (SELECT h.q, h.rank, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS good FROM h LEFT JOIN g ON h.q = g.q AND h.id = g.id WHERE rank <= 10)
SELECT m.q AS "query", round(sum(good) / count(*), 6) AS "precision", round(sum(good) / max(n), 6) AS recall, round(coalesce(1 / min(CASE WHEN good = 1 THEN rank END), 0), 6) AS mrr FROM m JOIN (SELECT q, count(*) AS n FROM g GROUP BY q) o ON o.q = m.q GROUP BY m.q""")
def retrieval_quality(t):
    e = t("embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    from pyspark.sql import Window

    hits = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return search.retrieval_quality(hits, e.filter("id % 3 = 0")).select("query", "precision", "recall", "mrr")


@query("""WITH h AS (SELECT label AS q, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
n AS (SELECT label AS q, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label),
d AS (SELECT q, sum(CASE WHEN id % 3 = 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h WHERE rank <= 10 GROUP BY q)
SELECT d.q AS "query", round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n.n), 5) AS ndcg FROM d JOIN n ON n.q = d.q""")
def retrieval_ndcg(t):
    """The discounted gain of the same rankings."""
    from pyspark.sql import Window

    e = t("embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    hits = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return search.retrieval_quality(hits, e.filter("id % 3 = 0")).select("query", F.round("ndcg", 5).alias("ndcg"))


@query("""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS name, substr(text, 1, 80) AS summary, text, doc_id % 4 AS importance FROM documents),
i AS (SELECT '  name: ' || name || ' | summary: ' || summary || ' | importance: ' || importance AS l, row_number() OVER (ORDER BY importance DESC, id) AS r FROM n WHERE importance >= 2),
k AS (SELECT '  name: ' || name || ' | type: document | summary: ' || summary || ' | importance: ' || importance AS l, row_number() OVER (ORDER BY importance DESC, id) AS r FROM n WHERE text ILIKE '%worthless%' OR text ILIKE '%idiot%')
SELECT 'documents' AS part, md5('=== IMPORTANT DOCUMENTS ===' || chr(10) || string_agg(l, chr(10) ORDER BY r)) AS section FROM i WHERE r <= 10 HAVING count(*) > 0
UNION ALL SELECT 'search_results', md5('=== SEARCH RESULTS ===' || chr(10) || string_agg(l, chr(10) ORDER BY r)) FROM k WHERE r <= 10 HAVING count(*) > 0""")
def retrieval_context(t):
    """Sections for a question, from documents as nodes."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("type"), F.lit("note").alias("subtype"), F.col("source").alias("name"), F.substring("text", 1, 80).alias("summary"), F.col("text").alias("content"), (F.col("doc_id") % 4).cast("int").alias("importance"), F.lit(None).cast("timestamp").alias("effective_start"), F.lit(None).cast("timestamp").alias("effective_end"), F.lit(None).cast("timestamp").alias("updated_at"))
    return api.prompt_sections(api.retrieve(docs, "worthless idiot", "2024-01-15 00:00:00")).select("part", F.md5("section").alias("section"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")
def top_event_types(t):
    return relational.top(relational.count_by(t("events"), "event_type"), 3, F.desc("n"), "event_type")
