"""Registered queries: de-duplication and grouping (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, encoders, fusion, grouping, lexical, topics, vectors
from ..session import cut_lineage, scratch_folder
from . import sqlparts as Q
from .queries_corpus import heading_sql, key_terms_sql
from .registry import query

GROUPS = {
    "bm20": Q.ranked("bm25", 20),
    "h_tf": f"""
      SELECT query_id, chunk_id, n, term, count(*) AS tf FROM (
        SELECT query_id, chunk_id, n, unnest({Q.terms('text')}) AS term FROM (
          SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM bm20) JOIN chunks USING (chunk_id) WHERE n >= 5)
      GROUP BY 1, 2, 3, 4""",
    "h_vocab": """
      SELECT query_id, term, df FROM (
        SELECT query_id, term, n, count(*) AS df, sum(tf) AS total FROM h_tf GROUP BY 1, 2, 3) WHERE df >= 2 AND df <= 0.85 * n
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, term) <= 1000""",
    "h_w": """
      SELECT query_id, chunk_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id, chunk_id)) AS weight FROM (
        SELECT query_id, chunk_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM h_tf JOIN h_vocab USING (query_id, term))""",
    "h_sim": """
      SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, round(sum(x.weight * y.weight), 6) AS similarity
      FROM h_w x JOIN h_w y ON x.query_id = y.query_id AND x.term = y.term AND x.chunk_id < y.chunk_id GROUP BY 1, 2, 3""",
    "h_edges": "SELECT query_id, a, b FROM h_sim WHERE similarity >= 0.7",
    "h_both": "SELECT query_id, a, b FROM h_edges UNION ALL SELECT query_id, b, a FROM h_edges",
    "h_reach": "SELECT query_id, a, b FROM h_both UNION SELECT r.query_id, r.a, e.b FROM h_reach r JOIN h_both e ON r.query_id = e.query_id AND r.b = e.a",
    "h_part": "SELECT query_id, a AS chunk_id, min(b) AS root FROM (SELECT * FROM h_reach UNION SELECT query_id, a, a FROM h_both) GROUP BY 1, 2",
    "h_order": """
      SELECT query_id, root, (row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, root) - 1)::INT AS cluster_id
      FROM h_part GROUP BY 1, 2""",
    "h_clusters": """
      SELECT h.query_id, h.chunk_id, o.cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM bm20) h
      LEFT JOIN h_part p USING (query_id, chunk_id) LEFT JOIN h_order o ON o.query_id = h.query_id AND o.root = p.root WHERE n >= 5""",
    "h_size": "SELECT query_id, cluster_id, count(*) AS n FROM h_clusters WHERE cluster_id IS NOT NULL GROUP BY 1, 2",
    "h_all": """
      SELECT query_id, chunk_id, cluster_id, false AS assigned FROM h_clusters WHERE cluster_id IS NOT NULL UNION ALL
      SELECT query_id, chunk_id, cluster_id, true FROM (
        SELECT z.query_id, z.chunk_id, s.cluster_id, round(coalesce(t.total, 0) / s.n, 6) AS score
        FROM h_clusters z JOIN h_size s USING (query_id) LEFT JOIN (
          SELECT x.query_id, x.c AS chunk_id, m.cluster_id, sum(similarity) AS total FROM (
            SELECT query_id, a AS c, b AS other, similarity FROM h_sim UNION ALL SELECT query_id, b, a, similarity FROM h_sim) x
          JOIN h_clusters m ON m.query_id = x.query_id AND m.chunk_id = x.other AND m.cluster_id IS NOT NULL
          GROUP BY 1, 2, 3) t ON t.query_id = z.query_id AND t.chunk_id = z.chunk_id AND t.cluster_id = s.cluster_id
        WHERE z.cluster_id IS NULL)
      QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, cluster_id) = 1""",
    "h_texts": """
      SELECT query_id, cluster_id, string_agg(text, ' ' ORDER BY rank) AS text FROM h_all JOIN bm20 USING (query_id, chunk_id)
      JOIN chunks USING (chunk_id) GROUP BY 1, 2""",
}


def _hits(t):
    return fusion.with_text(t.bm25_hits(20), t.chunks)


def _hits_with_place(t):
    return t.bm25_hits(20).join(t.chunks.select("chunk_id", "doc_id", "chunk_index", "text"), "chunk_id")


def _clusters(t, hits):
    similarities = grouping.topic_similarities(grouping.topic_weights(hits))
    return grouping.cluster_topics(hits, grouping.topic_edges(similarities)), similarities


def _document_vectors(t):
    docs = t.documents.select(F.col("doc_id"), F.col("text"))
    return encoders.embed(docs, encoders.hashing_encoder(64), dims=64).select("doc_id", "embedding")


DENSE = {
    "doc_vec": Q.hash_vectors("documents", "doc_id", "text"),
    "dense": """
      SELECT doc_id, list(coalesce(x, 0.0) ORDER BY i) AS e FROM (SELECT doc_id, i FROM documents, range(64) r(i))
      LEFT JOIN (SELECT doc_id, d AS i, x FROM doc_vec) USING (doc_id, i) GROUP BY 1""",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings",
}


def _later(table: str, key: str, threshold: float) -> str:
    """All pairs of rows above the threshold; a vector without length is similar to nothing."""
    return f"""
      SELECT id_a, id_b, similarity FROM (
        SELECT a.{key} AS id_a, b.{key} AS id_b,
               round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) + 1e-9, 6) AS similarity
        FROM {table} a JOIN {table} b ON a.{key} < b.{key}
        WHERE list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0) WHERE similarity > {threshold}"""


def _greedy(table: str, key: str, threshold: float) -> str:
    """Rows in key order; a row stays if no kept row is similar to it."""
    return Q.sql(f"""
      SELECT unnest(kept) AS {key} FROM (SELECT kept FROM greedy ORDER BY n DESC LIMIT 1)""",
      pairs=_later(table, key, threshold),
      lined=f"""SELECT {key} AS id, row_number() OVER (ORDER BY {key}) AS n, coalesce(before, []) AS before FROM {table}
                LEFT JOIN (SELECT id_b, list(id_a) AS before FROM pairs GROUP BY 1) ON id_b = {key}""",
      greedy="""SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL
                SELECT l.n, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, id) END FROM greedy g JOIN lined l ON l.n = g.n + 1""",
      **DENSE)


@query("h1_similar_pairs", Q.sql("""
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) <= 10""",
    pairs=_later("vecs", "vec_id", 0.35), **DENSE))
def _(t):
    # keys spare nothing at so low a threshold
    return vectors.similar_pairs(t.embeddings, 0.35, exact=True)


@query("h1_similar_documents", Q.sql("""
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) <= 10""",
    pairs=_later("dense", "doc_id", 0.95), **DENSE))
def _(t):
    return vectors.similar_pairs(_document_vectors(t), 0.95, key="doc_id", miss=1e-9)


@query("h2_semantic_dedup", _greedy("vecs", "vec_id", 0.35))
def _(t):
    return dedup.semantic_dedup(t.embeddings.select("vec_id", "embedding"), 0.35, key="vec_id", exact=True)


@query("h2_semantic_dedup_documents", _greedy("dense", "doc_id", 0.95))
def _(t):
    return dedup.semantic_dedup(_document_vectors(t), 0.95, key="doc_id")


@query("h3_dedup_stats", f"""
    SELECT count(*) AS original_rows, count(DISTINCT n) AS kept_rows, count(*) - count(DISTINCT n) AS removed_rows,
           round(100.0 * (count(*) - count(DISTINCT n)) / count(*), 6) AS removal_percentage,
           round(count(DISTINCT n)::DOUBLE / count(*), 6) AS compression_ratio
    FROM (SELECT {Q.normalized("coalesce(text, '')")} AS n FROM documents)""")
def _(t):
    return dedup.dedup_stats(t.documents, dedup.exact_dedup(t.documents))


@query("h4_exact_dedup", f"""
    SELECT sha256({Q.normalized("coalesce(text, '')")}) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies
    FROM documents GROUP BY 1""")
def _(t):
    return dedup.exact_dedup(t.documents)


@query("h5_dedup_context")
def _(t):
    return dedup.dedup_context(_hits(t))


@query("h6_group_consecutive", Q.sql("""
    SELECT query_id, doc_id, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS size FROM (
      SELECT query_id, doc_id, chunk_index, chunk_index - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS run
      FROM bm20 JOIN chunks USING (chunk_id)) GROUP BY query_id, doc_id, run""", **GROUPS))
def _(t):
    return grouping.group_consecutive(_hits_with_place(t))


@query("h7_group_semantic")
def _(t):
    return grouping.group_semantic(t.bm25_hits(20), t.chunk_vectors)


@query("h8_topic_edges", Q.sql("SELECT query_id, a, b, similarity FROM h_sim WHERE similarity >= 0.7", **GROUPS))
def _(t):
    return grouping.topic_edges(grouping.topic_similarities(grouping.topic_weights(_hits(t))))


@query("h8_cluster_topics", Q.sql("SELECT * FROM h_clusters", **GROUPS))
def _(t):
    return _clusters(t, cut_lineage(_hits(t)))[0]


_DOC_TERMS = {
    "doc_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.terms("coalesce(text, '')")}) AS term FROM documents) GROUP BY 1, 2",
    "doc_idf": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM doc_tf GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM documents)",
    "doc_weights": "SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, term, tf * idf AS raw FROM doc_tf JOIN doc_idf USING (term))",
    "near_docs": """SELECT x.doc_id AS a, y.doc_id AS b FROM doc_weights x JOIN doc_weights y ON x.term = y.term AND x.doc_id <> y.doc_id
                    GROUP BY 1, 2 HAVING round(sum(x.weight * y.weight) + 1e-9, 6) >= 0.6""",
    "reached": "SELECT a AS node, b AS other FROM near_docs UNION SELECT r.node, n.b FROM reached r JOIN near_docs n ON r.other = n.a",
    "grouped_docs": "SELECT node AS doc_id, least(node, min(other)) AS topic FROM reached GROUP BY node",
}


@query("h8_corpus_topics", Q.sql("SELECT doc_id, topic, count(*) OVER (PARTITION BY topic) AS size FROM grouped_docs", **_DOC_TERMS))
def _(t):
    docs = t.documents.select("doc_id", T.text_of("text").alias("text"))
    index = lexical.build_postings(docs, T.terms, "doc_id").stored(scratch_folder(t.spark, "doc-terms"))
    return topics.corpus_topics(lexical.tfidf_rows(index), index.vocabulary, 0.6, "doc_id")


@query("h9_assign_noise", Q.sql("SELECT * FROM h_all", **GROUPS))
def _(t):
    return grouping.assign_noise(*_clusters(t, cut_lineage(_hits(t))))


@query("h10_topic_terms", Q.sql("""
    SELECT query_id, cluster_id, string_agg(term, ', ' ORDER BY r) AS terms FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY s DESC, term) AS r FROM (
        SELECT query_id, cluster_id, term, round(sum(weight), 6) AS s FROM h_all JOIN tfidf USING (chunk_id) GROUP BY 1, 2, 3)
      QUALIFY r <= 5) GROUP BY 1, 2""", **GROUPS))
def _(t):
    clusters = grouping.assign_noise(*_clusters(t, cut_lineage(_hits(t))))
    return grouping.topic_terms(clusters, lexical.tfidf(t.index(T.terms)))


@query("h11_cross_references", Q.sql(f"""
    SELECT k.query_id, k.cluster_id, o.cluster_id AS other_id, count(*) AS shared FROM (
      SELECT query_id, cluster_id, unnest({key_terms_sql('text')}) AS term FROM h_texts) k
    JOIN h_texts o ON o.query_id = k.query_id AND o.cluster_id <> k.cluster_id AND contains(lower(o.text), lower(k.term))
    GROUP BY 1, 2, 3 HAVING count(*) >= 2""", **GROUPS))
def _(t):
    hits = cut_lineage(_hits(t))
    clusters = grouping.assign_noise(*_clusters(t, hits))
    return grouping.cross_references(grouping.cluster_texts(clusters, hits))


@query("h12_enrich_context")
def _(t):
    hits = cut_lineage(_hits_with_place(t))
    kept = cut_lineage(hits.join(dedup.dedup_context(hits).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"))
    clusters = cut_lineage(grouping.assign_noise(*_clusters(t, kept)))
    texts = grouping.cluster_texts(clusters, kept)
    return grouping.enrich_context(clusters, kept, texts, grouping.cross_references(texts))
