"""Corpora, chunks, vector search, routing and token costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens import sinks, sources
from spendlens.functions import columns as C, text as X
from spendlens.operators import retrieval as R, vector_index as V
from spendlens.plans.registry import query
from spendlens.plans.tables import corpus, messages, table, vectors
from spendlens.session import shared_dir
from spendlens.sources.documents import as_corpus, metadata_map, union_corpora


def page_corpus(spark, sf_dir):
    """The pages as documents: visible text, and metadata keys the documents do not have."""
    pages = table(spark, sf_dir, "pages")
    return as_corpus(pages, C.html_to_text("html"),
                     metadata_map(source=F.col("url"), type=F.lit("html"), category=C.document_category("url")))


# The entities of html_to_text, undone in the same order.
PAGE_TEXT_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<head\b.*?</head\s*>', ' ', 'gis'),
    '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("s7_page_text", f"""
SELECT sha256(content) AS doc_id, length(content) AS n_chars, url AS source, 'general' AS category
FROM (SELECT url, {PAGE_TEXT_SQL} AS content FROM pages)""")
def s7_page_text(spark, sf_dir):
    """Documents from html: visible text with source, type and category."""
    return page_corpus(spark, sf_dir).select(
        "doc_id", F.length("content").alias("n_chars"), F.col("metadata")["source"].alias("source"),
        F.col("metadata")["category"].alias("category"))


# Keywords that occur in the given urls; the default ones are covered by tests.
URL_RULES = (("blog", ("blog", "feed")), ("spam", ("spam",)), ("secure", ("https",)))


@query("e13_document_category", """
SELECT page_id, CASE WHEN contains(lower(url), 'blog') OR contains(lower(url), 'feed') THEN 'blog'
  WHEN contains(lower(url), 'spam') THEN 'spam' WHEN contains(lower(url), 'https') THEN 'secure' ELSE 'general' END
  AS category FROM pages""")
def e13_document_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.document_category("url", URL_RULES).alias("category"))


WORD_ROUTES = (("portfolio_advisor", ("the", "and")), ("tax_advisor", ("ion",)))


@query("e14_advice_route", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'and') THEN 'portfolio_advisor'
  WHEN contains(lower(text), 'ion') THEN 'tax_advisor' ELSE 'general_financial_advisor' END AS agent
FROM conversations WHERE role = 'user'""")
def e14_advice_route(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", C.advice_route("text", WORD_ROUTES).alias("agent"))


@query("e15_snippets", """
SELECT doc_id, substr(text, 1, 500) || '...' AS content, coalesce(source, 'Unknown') AS source, 'general' AS type
FROM documents""")
def e15_snippets(spark, sf_dir):
    """Citation form of every document; the documents have no type of their own."""
    hits = corpus(spark, sf_dir).withColumns({"query_id": F.lit(0), "position": F.lit(0)})
    return R.citations(hits.withColumn("query_id", F.col("doc_id").cast("long"))).select(
        F.col("query_id").alias("doc_id"), "content", "source", "type")


@query("e17_metadata_split", "SELECT doc_id, text AS content, 'lang=' || lang AS metadata FROM documents")
def e17_metadata_split(spark, sf_dir):
    rest = F.map_entries(C.metadata_without("metadata", "source"))
    return corpus(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"), "content",
        F.concat_ws(",", F.transform(rest, lambda e: F.concat_ws("=", e.key, e.value))).alias("metadata"))


@query("p11_payload_filter", """
SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'""")
def p11_payload_filter(spark, sf_dir):
    criteria = {"lang": ["en", "de"], "source": "src3"}
    return corpus(spark, sf_dir).filter(C.payload_matches(criteria, "metadata")).select(
        F.col("doc_id").cast("long").alias("doc_id"))


@query("k10_documents_once", "SELECT DISTINCT sha256(text) AS doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def k10_documents_once(spark, sf_dir):
    """Documents that come twice, under the hash of their text, in three batches of which two overlap."""
    path = shared_dir(spark, "corpus")
    texts = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1", "doc_id % 3 = 2"):
        sinks.add_documents(as_corpus(texts.filter(part), F.col("text"), metadata_map(lang=F.col("lang"))), path)
    return spark.read.parquet(path).select("doc_id", F.length("content").cast("long").alias("n_chars"))


@query("d1_chunks")
def d1_chunks(spark, sf_dir):
    return R.chunk_documents(corpus(spark, sf_dir).drop("metadata"))


@query("d4_corpus_chunks")
def d4_corpus_chunks(spark, sf_dir):
    """Documents and pages as one corpus, cut into chunks."""
    chunks = R.build_corpus(corpus(spark, sf_dir), page_corpus(spark, sf_dir))
    return chunks.select("doc_id", "chunk_no", "chunk", F.col("metadata")["source"].alias("source"))


CHUNK_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, TRUE AS short_enough, TRUE AS first_is_prefix, TRUE AS last_is_suffix,
       length(trim(text, ' ' || chr(10))) <= 1000 AS single, TRUE AS in_order FROM documents
WHERE length(trim(text, ' ' || chr(10))) > 0"""


def _chunk_invariants(chunks, texts):
    """What must hold for the chunks of any document."""
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest"), F.max("chunk_no").alias("last"),
        F.min_by("chunk", "chunk_no").alias("head"), F.max_by("chunk", "chunk_no").alias("tail"))
    text = F.btrim("content", F.lit(" \n"))
    return texts.join(per_doc, "doc_id").select(
        "doc_id", (F.col("longest") <= 1000).alias("short_enough"), text.startswith(F.col("head")).alias("first_is_prefix"),
        text.endswith(F.col("tail")).alias("last_is_suffix"), (F.col("n") == 1).alias("single"),
        (F.col("last") == F.col("n") - 1).alias("in_order"))


@query("d1_chunk_invariants", CHUNK_SQL)
def d1_chunk_invariants(spark, sf_dir):
    texts = corpus(spark, sf_dir).drop("metadata")
    return _chunk_invariants(R.chunk_documents(texts), texts)


@query("d4_corpus_chunk_invariants", CHUNK_SQL.replace("FROM documents", f"""FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
  UNION ALL SELECT DISTINCT sha256(content), content FROM (SELECT {PAGE_TEXT_SQL} AS content FROM pages))"""))
def d4_corpus_chunk_invariants(spark, sf_dir):
    """The same for the union of documents and different pages."""
    sources = corpus(spark, sf_dir), page_corpus(spark, sf_dir).dropDuplicates(["doc_id"])
    return _chunk_invariants(R.build_corpus(*sources).drop("metadata"), union_corpora(*sources).drop("metadata"))


@query("u1_corpus_union", """
SELECT coalesce(lang, 'html') AS kind, count(*) AS documents FROM (
  SELECT lang FROM documents UNION ALL SELECT NULL FROM pages) GROUP BY 1""")
def u1_corpus_union(spark, sf_dir):
    """Sources with different columns as one bag."""
    documents = corpus(spark, sf_dir).withColumn("lang", F.col("metadata")["lang"])
    both = union_corpora(documents, page_corpus(spark, sf_dir))
    return both.groupBy(F.coalesce("lang", F.lit("html")).alias("kind")).agg(F.count("*").alias("documents"))


@query("d3_unit_vectors", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2)))), 6) AS norm,
       round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2)))), 6) AS first
FROM embeddings""")
def d3_unit_vectors(spark, sf_dir):
    unit = X.unit_vector("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(X.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(unit, F.lit(0)), 6).alias("first"))


# The mean vector of every label is a question; the whole table is searched.
SCORES_SQL = """WITH elements AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM elements GROUP BY 1, 2),
questions AS (SELECT label AS query_id, list(x ORDER BY i) AS question FROM means GROUP BY 1),
scores AS (SELECT query_id, vec_id AS hit_id, label, list_cosine_similarity(question, embedding::DOUBLE[]) AS score
  FROM questions, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS position
  FROM scores WHERE score >= {threshold}{criteria})
SELECT query_id, hit_id, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM ranked
WHERE position <= {k}"""


def _questions(spark, sf_dir):
    elements = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = elements.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("m")).select(
        "query_id", F.col("m.x").alias("embedding"))


def _rounded(hits):
    return hits.select("query_id", "hit_id", F.round("score", 6).alias("score"), "position")


@query("t2_top_k", SCORES_SQL.format(threshold=0.3, criteria="", k=5))
def t2_top_k(spark, sf_dir):
    return _rounded(R.search(vectors(spark, sf_dir), _questions(spark, sf_dir), k=5, threshold=0.3))


@query("d2_filtered_search", SCORES_SQL.format(threshold=0.1, criteria=" AND label IN (0, 2, 3)", k=4))
def d2_filtered_search(spark, sf_dir):
    """Search with a metadata filter."""
    hits = R.search(vectors(spark, sf_dir), _questions(spark, sf_dir), k=4, threshold=0.1,
                    criteria={"category": ["0", "2", "3"]})
    return _rounded(hits)


@query("j3_similarity_join", SCORES_SQL.format(threshold=0.25, criteria="", k=1000000000).replace(
    ", CAST(position AS INTEGER) AS position", ""))
def j3_similarity_join(spark, sf_dir):
    """All corpus vectors within the threshold of a query."""
    hits = R.similar(vectors(spark, sf_dir), _questions(spark, sf_dir), threshold=0.25)
    return hits.select("query_id", "hit_id", F.round("score", 6).alias("score"))


# The same with every row whose id is divisible by 20 as a question, against an index of the whole table.
ROWS_SQL = """WITH questions AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS question FROM embeddings WHERE vec_id % 20 = 0),""" + SCORES_SQL[
    SCORES_SQL.index("\nscores AS"):]


def _row_questions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _index(spark, sf_dir):
    return V.build(vectors(spark, sf_dir), shared_dir(spark, "vector-index"))


@query("t2_top_k_rows", ROWS_SQL.format(threshold=0.3, criteria="", k=5))
def t2_top_k_rows(spark, sf_dir):
    return _rounded(V.search(_index(spark, sf_dir), _row_questions(spark, sf_dir), k=5, threshold=0.3))


@query("d2_filtered_search_rows", ROWS_SQL.format(threshold=0.1, criteria=" AND label IN (0, 2, 3)", k=4))
def d2_filtered_search_rows(spark, sf_dir):
    hits = V.search(_index(spark, sf_dir), _row_questions(spark, sf_dir), k=4, threshold=0.1,
                    criteria={"category": ["0", "2", "3"]})
    return _rounded(hits)


@query("j3_similarity_join_rows", ROWS_SQL.format(threshold=0.25, criteria="", k=1000000000).replace(
    ", CAST(position AS INTEGER) AS position", ""))
def j3_similarity_join_rows(spark, sf_dir):
    hits = V.similar(_index(spark, sf_dir), _row_questions(spark, sf_dir), threshold=0.25)
    return hits.select("query_id", "hit_id", F.round("score", 6).alias("score"))


@query("a13_collection_info", """
SELECT CAST(label AS VARCHAR) AS category, count(*) AS points_count, CAST(max(len(embedding)) AS INTEGER) AS vector_size
FROM embeddings GROUP BY 1""")
def a13_collection_info(spark, sf_dir):
    return R.collection_info(vectors(spark, sf_dir))


@query("k11_vector_upsert", """
SELECT vec_id, CASE WHEN label IN (1, 4) THEN 'changed' ELSE CAST(label AS VARCHAR) END AS category FROM embeddings""")
def k11_vector_upsert(spark, sf_dir):
    """Two labels arrive twice with new payloads; the later version wins."""
    collection = vectors(spark, sf_dir)
    changed = collection.filter("category IN ('1', '4')")
    incoming = (changed.withColumns({"category": F.lit("draft"), "version": F.lit(1)})
                .unionByName(changed.withColumns({"category": F.lit("changed"), "version": F.lit(2)})))
    return R.upsert(collection, incoming, order_by="version").select("vec_id", "category")


@query("k12_vector_delete", "SELECT vec_id FROM embeddings WHERE label <> 7")
def k12_vector_delete(spark, sf_dir):
    collection = vectors(spark, sf_dir)
    return R.delete_points(collection, collection.filter("category = '7'")).select("vec_id")


TOKENS_SQL = """WITH names(i, model) AS (VALUES (0, 'gpt-4'), (1, 'gpt-4-turbo'), (2, 'gpt-3.5-turbo'),
  (3, 'claude-2'), (4, 'unlisted')), prices(model, p_in, p_out) AS (VALUES ('gpt-4', 0.03::DOUBLE, 0.06::DOUBLE),
  ('gpt-4-turbo', 0.01, 0.03), ('gpt-3.5-turbo', 0.0015, 0.002), ('claude-2', 0.01102, 0.03268)),
usage AS (SELECT conv_id, model,
    CAST(sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS output_tokens
  FROM conversations JOIN names ON conv_id % 5 = i GROUP BY 1, 2)"""


@query("a14_token_costs", TOKENS_SQL + """
SELECT conv_id, model, input_tokens, output_tokens, round(input_tokens / 1000 * coalesce(p_in, 0.03::DOUBLE)
  + output_tokens / 1000 * coalesce(p_out, 0.06::DOUBLE), 10) AS cost FROM usage LEFT JOIN prices USING (model)""")
def a14_token_costs(spark, sf_dir):
    return R.token_costs(messages(spark, sf_dir), "conv_id", digits=10)


@query("j7_price_lookup", TOKENS_SQL + """
SELECT conv_id, model, coalesce(p_in, 0.03::DOUBLE) AS input_price, coalesce(p_out, 0.06::DOUBLE) AS output_price
FROM usage LEFT JOIN prices USING (model)""")
def j7_price_lookup(spark, sf_dir):
    usage = messages(spark, sf_dir).select("conv_id", "model").distinct()
    return R.with_prices(usage).select("conv_id", "model", "input_price", "output_price")
