"""Registered queries: evaluation of retrieval and answers (V).

Configurations are two plans at four depths. The expected answer of a benchmark text is the text
itself; latency of a question is the mean event value of the user with its number; labels of the best
document are the feedback.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V, scores as S, text as T
from ..operators import encoders, evaluation as E, fusion
from ..session import cut_lineage
from . import grid, sqlparts as Q
from .queries_corpus import facts_sql
from .queries_logs import LOGS, expectations_of
from .registry import query

PLANS, KS = ["bm25", "vector"], [1, 3, 5, 10]

ROWS = {
    **LOGS,
    "plan_hits": "SELECT 'bm25' AS plan, query_id, chunk_id, score, rank FROM bm10 UNION ALL SELECT 'vector', query_id, chunk_id, score, rank FROM vec10",
    "scaled": """SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS s
                 FROM plan_hits JOIN chunks USING (chunk_id) WINDOW w AS (PARTITION BY plan, query_id)""",
    "lat": f"SELECT plan, user_id AS query_id, avg(value) / 100 AS latency FROM events, (SELECT unnest({PLANS}) AS plan) GROUP BY 1, 2",
    "eval_rows": f"""
      SELECT plan || '-' || k AS config_id, plan, k, query_id, query, answer, context, coalesce(latency, 0) AS latency,
             coalesce(similarity, 0) AS similarity, coalesce(feedback, 'neutral') AS feedback, answer IS NULL AS error
      FROM (SELECT * FROM queries, (SELECT unnest({PLANS}) AS plan), (SELECT unnest({KS}) AS k))
      LEFT JOIN (
        SELECT plan, k, query_id, avg(s) AS similarity, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context,
               max(CASE WHEN rank = 1 THEN text END) AS answer,
               max(CASE WHEN rank = 1 THEN CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END END) AS feedback
        FROM scaled JOIN (SELECT unnest({KS}) AS k) ON rank <= k LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3)
      USING (plan, k, query_id) LEFT JOIN lat USING (plan, query_id)""",
    "measured": f"""
      SELECT config_id, plan, k, query_id, latency, similarity, feedback, error,
             round({Q.overlap('query', "coalesce(answer, '')")} + 1e-9, 6) AS correctness,
             CASE WHEN coalesce(answer, '') IN ('', 'ERROR') THEN 0.0 WHEN length(answer) < 100 THEN 0.3 WHEN length(answer) < 250 THEN 0.7 ELSE 1.0 END AS completeness,
             round(least({Q.count_of("lower(coalesce(answer, ''))", V.SPECIFIC_MARKS)} / 3.0, 1.0) + 1e-9, 6) AS specificity,
             round({Q.overlap('query', "coalesce(context, '')")} + 1e-9, 6) AS recall FROM eval_rows""",
    "scored": """
      SELECT *, round(greatest(0, least(1, 0.5 * correct::INT + 0.2 * completeness + 0.2 * recall + 0.1 * (1 - least(latency / 2, 1)))) + 1e-9, 6) AS composite
      FROM (SELECT *, correctness >= 0.5 AS correct, recall >= 0.3 AS context_hit FROM measured)""",
}


def _mean(c: str, to: str) -> str:
    return f"round(coalesce(avg({c}) FILTER (NOT error), 0) + 1e-9, 6) AS {to}"


SUMMARY_OF = f"""
    SELECT config_id, plan, k, count(*) AS n, round(avg((NOT error)::INT) + 1e-9, 6) AS success_rate, {_mean('latency', 'avg_latency')},
      {_mean('similarity', 'avg_similarity')}, {_mean('context_hit::INT', 'hit_rate')}, {_mean('correctness', 'avg_correctness')},
      {_mean('completeness', 'avg_completeness')}, {_mean('specificity', 'avg_specificity')}, {_mean('composite', 'avg_composite')},
      {_mean("(feedback = 'positive')::INT", 'positive_rate')}, {_mean("(feedback = 'negative')::INT", 'negative_rate')},
      {_mean("(feedback = 'neutral')::INT", 'neutral_rate')} FROM __rows GROUP BY 1, 2, 3"""
OVERALL = """round(least(1.0, 0.3 * hit_rate + 0.25 * avg_correctness + 0.1 * avg_completeness + 0.05 * avg_specificity
    + 0.2 * success_rate + least(0.1, 0.2 / greatest(avg_latency, 0.1))) + 1e-9, 6)"""
SUCCESS = "round(0.6 * avg_composite + 0.4 * avg_similarity + 1e-9, 6)"
CONFIGS = {**ROWS, "summary": SUMMARY_OF.replace("__rows", "scored")}
BM_CTX = Q.context_sql("(SELECT query_id, rank, source, text FROM bm10 JOIN chunks USING (chunk_id))", 6000)
CONTENT = {**LOGS, "ctx": BM_CTX, "shown": "SELECT query_id, rank, chunk_id, text FROM bm10 JOIN chunks USING (chunk_id)",
           "judged": "SELECT query_id, rank, kind, phrase, contains(lower(text), lower(phrase)) AS found FROM shown JOIN expected USING (query_id)",
           "told": """SELECT query_id, kind, phrase, coalesce(contains(lower(context), lower(phrase)), false) AS found, context IS NOT NULL AS has
                      FROM expected LEFT JOIN ctx USING (query_id)""",
           "should": "SELECT query_id, chunk_id FROM bm10 WHERE rank <= 3",
           "bm_best": "SELECT query_id, text AS answer FROM shown WHERE rank = 1"}


def latency_of(t):
    return t.events.groupBy(F.col("user_id").alias("query_id")).agg((F.avg("value") / 100).alias("latency"))


def scored_of(t):
    docs = F.split_part("chunk_id", F.lit("-"), F.lit(1)).cast("long")
    t.store()
    hits = (t.bm25_hits(10).withColumn("plan", F.lit("bm25"))
            .unionByName(t.vector_hits(10).withColumn("plan", F.lit("vector"))))
    hits = fusion.with_text(hits, t.chunks).drop("source").withColumn("doc_id", docs)
    # the tables hold no times of single plans: both have the mean over all events of a user
    latency = latency_of(t).withColumn("plan", F.explode(F.array(*[F.lit(p) for p in PLANS])))
    feedback = t.labels.select("doc_id", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("feedback"))
    return E.score_rows(E.eval_rows(t.queries, hits, latency, feedback, KS, PLANS))


def summary_of(t):
    # A few rows per plan and depth, read several times below.
    return cut_lineage(E.summarise_configs(scored_of(t)))


def shown_of(t):
    return fusion.with_text(t.bm25_hits(10), t.chunks)


def contexts_of(t, shown=None):
    return fusion.assemble_context(shown if shown is not None else shown_of(t), 6000)


# --- questions and configurations -------------------------------------------------------------

_ASKS, _MARKS = ["the", "der ", "les "], ["tion", "ein"]
_ODD_ANSWER = "CASE WHEN length(answer) % 7 = 0 THEN 'I cannot help with that.' WHEN length(answer) % 7 = 1 THEN 'Yes.' ELSE answer END"


def _odd_qa(t):
    n = F.length("answer") % 7
    return t.qa.withColumn("answer", F.when(n == 0, "I cannot help with that.").when(n == 1, "Yes.").otherwise(F.col("answer")))


@query("v1_validate_qa", Q.sql(f"""
    SELECT query_id, unnest(list_filter([{', '.join(f"CASE WHEN contains(lower(answer), {Q.lit(p.lower())}) THEN {Q.lit('generic: ' + p)} END" for p in V.GENERIC_ANSWERS)},
        CASE WHEN length(question) > 100 AND length(answer) < 30 THEN 'short answer to a long question' END,
        CASE WHEN {Q.any_of('lower(question)', _ASKS)} AND NOT {Q.any_of('lower(answer)', _MARKS)} THEN 'no source mark' END], lambda x: x IS NOT NULL)) AS issue
    FROM (SELECT query_id, question, {_ODD_ANSWER} AS answer FROM qa)"""))
def _(t):
    return E.validate_qa(_odd_qa(t), _ASKS, _MARKS)


_QUESTIONS = {"numbered_q": """
      SELECT source, query_id, row_number() OVER (PARTITION BY source ORDER BY query_id) AS pos, count(*) OVER (PARTITION BY source) AS n,
             count(*) OVER () AS total FROM (
        SELECT 'benchmark' AS source, query_id FROM queries UNION ALL SELECT 'conversations', query_id FROM qa)""",
              "picked_q": """
      SELECT source, query_id, pos FROM numbered_q WHERE total < 8 OR pos IN (1, n) OR (n >= 3 AND pos = n // 2 + 1)
      ORDER BY source, pos LIMIT 12""",
              "rest_q": """
      SELECT source, query_id, pos, row_number() OVER (ORDER BY source, pos) - 1 AS r, count(*) OVER () AS left_n,
             (SELECT count(*) FROM picked_q) AS chosen FROM numbered_q
      WHERE (source, query_id) NOT IN (SELECT source, query_id FROM picked_q)"""}


@query("v2_stratified_subset", Q.sql("""
    SELECT * FROM picked_q UNION ALL
    SELECT source, query_id, pos FROM rest_q WHERE chosen < 8 AND r % greatest(1, left_n // least(8 - chosen, left_n)) = 0
      AND r // greatest(1, left_n // least(8 - chosen, left_n)) < 12 - chosen""", **_QUESTIONS))
def _(t):
    questions = (t.queries.select(F.lit("benchmark").alias("source"), "query_id")
                 .unionByName(t.qa.select(F.lit("conversations").alias("source"), "query_id")))
    return E.stratified_subset(questions, F.floor(F.col("query_id") / 1_000_000_000))


@query("v3_config_grid", f"""
    SELECT embedding_model || '/' || chunk_size || '/' || rerank_top_k || '/' || plan AS config_id, embedding_model, chunk_size, rerank_top_k, plan,
           20 AS top_k, 0.25 AS similarity_threshold, 0.5 AS sparse_weight, 150 AS expansion_k, 512 AS max_sparse_length, chunks
    FROM (SELECT unnest({V.GRID_MODELS}) AS embedding_model), (SELECT unnest({V.GRID_RERANK_DEPTHS}) AS rerank_top_k), (SELECT unnest({V.PLAN_NAMES}) AS plan),
         (SELECT chunk_size, sum(ceil(n_chars / chunk_size))::BIGINT AS chunks FROM documents, (SELECT unnest({V.GRID_CHUNK_SIZES}) AS chunk_size) GROUP BY 1)""")
def _(t):
    return E.with_chunk_load(E.config_grid(t.spark), t.documents)


@query("v4_config_sample")
def _(t):
    return E.with_chunk_load(E.config_sample(t.spark, 165, seed=42), t.documents)


# --- rows ---------------------------------------------------------------------------------------

@query("v5_answer_correct_words", Q.sql("SELECT config_id, query_id, correctness, correct FROM scored", **ROWS))
def _(t):
    return scored_of(t).select("config_id", "query_id", "correctness", "correct")


@query("v6_answer_correct_semantic", Q.sql("""
    SELECT query_id, greatest(0.0, score) AS similarity, score >= 0.8 AS correct FROM (SELECT query_id, chunk_id FROM bm10 WHERE rank = 1) JOIN vec USING (query_id, chunk_id)"""))
def _(t):
    enc = encoders.hashing_encoder(64)
    best = shown_of(t).filter("rank = 1").select("query_id", "text").join(t.queries, "query_id")
    df = encoders.embed(encoders.embed(best, enc, "text", "a"), enc, "query", "e")
    sim = F.greatest(F.lit(0.0), S.cosine(F.col("a"), F.col("e")))
    return df.select("query_id", F.round(sim + 1e-9, 6).alias("similarity"), (sim >= 0.8).alias("correct"))


_A = "answer || ' call 555-0100 or $' || length(question) || ' ' || length(answer)"
_X = "question || ' $' || length(question) || ' ' || length(answer) % 10 || ' 555-0100'"


def _fact_texts():
    q, a = F.length("question").cast("string"), F.length("answer")
    return (F.concat("answer", F.lit(" call 555-0100 or $"), q, F.lit(" "), a.cast("string")),
            F.concat("question", F.lit(" $"), q, F.lit(" "), (a % 10).cast("string"), F.lit(" 555-0100")))


@query("v7_fact_f1", Q.sql("""
    SELECT query_id, round(CASE WHEN len(e) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, e)) / (len(a) + len(e)) END + 1e-9, 6) AS f1
    FROM facts""", facts=f"SELECT query_id, {facts_sql('a')} AS a, {facts_sql('e')} AS e FROM (SELECT query_id, {_A} AS a, {_X} AS e FROM qa)"))
def _(t):
    a, e = _fact_texts()
    return t.qa.select("query_id", F.round(E.fact_f1(a, e) + 1e-9, 6).alias("f1"))


@query("v8_context_recall", Q.sql("""
    SELECT query_id, round(CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(a, e))::DOUBLE / len(e) END + 1e-9, 6) AS recall
    FROM facts""", facts=f"SELECT query_id, {facts_sql('a')} AS a, {facts_sql('e')} AS e FROM (SELECT query_id, {_A} AS a, {_X} AS e FROM qa)"))
def _(t):
    a, e = _fact_texts()
    return t.qa.select("query_id", F.round(E.fact_recall(a, e) + 1e-9, 6).alias("recall"))


@query("v9_composite", Q.sql("SELECT config_id, query_id, composite FROM scored", **ROWS))
def _(t):
    return scored_of(t).select("config_id", "query_id", "composite")


@query("v10_context_hit", Q.sql("SELECT config_id, query_id, recall, context_hit FROM scored", **ROWS))
def _(t):
    return scored_of(t).select("config_id", "query_id", "recall", "context_hit")


@query("v11_semantic_answer_score", Q.sql("""
    SELECT b.query_id, round(CASE WHEN text = '' OR starts_with(text, 'ERROR') THEN 0.0 ELSE
        0.7 * coalesce(asked, 0) + 0.2 * coalesce(told, 0) + 0.1 * least(length(text) / 100.0, 1.0) END + 1e-9, 6) AS score
    FROM best b LEFT JOIN (SELECT b.query_id, sum(q.x * c.x) AS asked FROM best b JOIN chunk_vec c USING (chunk_id) JOIN query_vec q ON q.query_id = b.query_id AND q.d = c.d GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT b.query_id, sum(x.x * c.x) AS told FROM best b JOIN chunk_vec c USING (chunk_id) JOIN ctx_vec x ON x.query_id = b.query_id AND x.d = c.d GROUP BY 1) USING (query_id)""",
    best="SELECT query_id, chunk_id, text FROM bm10 JOIN chunks USING (chunk_id) WHERE rank = 1", ctx=BM_CTX, ctx_vec=Q.hash_vectors("ctx", "query_id", "context")))
def _(t):
    enc = encoders.hashing_encoder(64)
    shown = shown_of(t)
    best = shown.filter("rank = 1").select("query_id", "text").join(t.queries, "query_id").join(contexts_of(t, shown), "query_id")
    df = encoders.embed(encoders.embed(encoders.embed(best, enc, "text", "a"), enc, "query", "q"), enc, "context", "c")
    score = E.semantic_answer_score(F.col("q"), F.col("q"), F.col("a"), F.col("c"), F.col("text"))
    return df.select("query_id", F.round(score + 1e-9, 6).alias("score"))


# --- configurations -----------------------------------------------------------------------------

@query("v12_summarise_configs", Q.sql("SELECT * FROM summary", **CONFIGS))
def _(t):
    return E.summarise_configs(scored_of(t))


@query("v13_overall_score", Q.sql(f"SELECT config_id, {OVERALL} AS score FROM summary", **CONFIGS))
def _(t):
    return E.summarise_configs(scored_of(t)).select("config_id", E.overall_score().alias("score"))


_SUBSET = {**ROWS,
           "numbered_q": _QUESTIONS["numbered_q"].split(" UNION ALL ")[0] + ")",
           "picked_q": _QUESTIONS["picked_q"], "rest_q": _QUESTIONS["rest_q"],
           "subset_q": """
    SELECT query_id FROM picked_q UNION ALL
    SELECT query_id FROM rest_q WHERE chosen < 8 AND r % greatest(1, left_n // least(8 - chosen, left_n)) = 0
      AND r // greatest(1, left_n // least(8 - chosen, left_n)) < 12 - chosen""",
           "first_summary": SUMMARY_OF.replace("__rows", "(SELECT * FROM scored WHERE query_id IN (SELECT query_id FROM subset_q))"),
           "chosen_c": f"""SELECT config_id, phase_one, position FROM (
               SELECT config_id, phase_one, row_number() OVER (ORDER BY phase_one DESC, config_id)::INT AS position, count(*) OVER () AS n
               FROM (SELECT config_id, {OVERALL} AS phase_one FROM first_summary)) WHERE position <= greatest(1, floor(0.3 * n))""",
           "second_summary": SUMMARY_OF.replace("__rows", "(SELECT * FROM scored WHERE config_id IN (SELECT config_id FROM chosen_c))")}


@query("v14_two_phase", Q.sql(f"SELECT config_id, {OVERALL} AS phase_two, phase_one, position FROM second_summary JOIN chosen_c USING (config_id)", **_SUBSET))
def _(t):
    questions = t.queries.select(F.lit("benchmark").alias("source"), "query_id")
    return E.two_phase(cut_lineage(scored_of(t)), E.stratified_subset(questions, F.floor(F.col("query_id") / 1_000_000_000)))


@query("v15_leaderboard", Q.sql(f"""
    SELECT config_id, {SUCCESS} AS score, avg_composite, avg_latency, success_rate, rank() OVER (ORDER BY {SUCCESS} DESC)::INT AS rank
    FROM summary ORDER BY score DESC, config_id LIMIT 5""", **CONFIGS))
def _(t):
    return E.leaderboard(summary_of(t), 5)


# --- the grid: chunk sizes, pipelines, rerank depths ----------------------------------------------

GRID_DEPTHS, GRID_K, GRID_LEAST = [20, 60], 10, 0.25


def _grid_sql() -> dict[str, str]:
    """Hits of all configurations and their evaluation against the assistant's answers."""
    parts, hits = {}, []
    for size in V.GRID_CHUNK_SIZES:
        own = {"sp10": Q.ranked("sparse", GRID_K)}
        for d in GRID_DEPTHS:
            own |= {f"vec{d}": Q.ranked("vec", d), f"sp{d}": Q.ranked("sparse", d), f"rr{d}": Q.rerank_sql(f"vec{d}", GRID_K), f"sprr{d}": Q.rerank_sql(f"sp{d}", GRID_K),
                    f"rrs{d}": Q.rerank_sql(f"vec{d}", 3 * GRID_K), f"rrsp{d}": f"SELECT s.query_id, s.chunk_id, s.score FROM sparse s JOIN rrs{d} USING (query_id, chunk_id)",
                    f"rrspk{d}": Q.ranked(f"rrsp{d}", GRID_K)}
            for plan, cte in (("vector_only", "vec10"), ("reranker_only", f"rr{d}"), ("splade_only", "sp10"), ("reranker_then_splade", f"rrspk{d}"), ("splade_then_reranker", f"sprr{d}")):
                hits.append(f"""SELECT '{V.GRID_MODELS[0]}/{size}/{d}/{plan}' AS config_id, query_id, doc_id, text, score, rank
                    FROM {cte}_{size} JOIN chunks_{size} USING (chunk_id) WHERE score >= {GRID_LEAST}""")
        parts |= Q.sized(size, 0, "SELECT query_id, question AS query FROM qa", **own)
    return {**parts, "grid_hits": " UNION ALL ".join(hits),
            "grid_configs": f"""
      SELECT '{V.GRID_MODELS[0]}/' || size || '/' || depth || '/' || plan AS config_id, plan, {GRID_K} AS k
      FROM (SELECT unnest({V.GRID_CHUNK_SIZES}) AS size), (SELECT unnest({GRID_DEPTHS}) AS depth), (SELECT unnest({V.PLAN_NAMES}) AS plan)""",
            "grid_scaled": """SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS s
                 FROM grid_hits WINDOW w AS (PARTITION BY config_id, query_id)""",
            "grid_lat": "SELECT user_id, avg(value) / 100 AS latency FROM events GROUP BY 1",
            "eval_rows": """
      SELECT config_id, plan, k, q.query_id, q.answer AS query, m.answer, context, coalesce(latency, 0) AS latency,
             coalesce(similarity, 0) AS similarity, coalesce(feedback, 'neutral') AS feedback, m.answer IS NULL AS error
      FROM qa q CROSS JOIN grid_configs LEFT JOIN (
        SELECT config_id, query_id, avg(s) AS similarity, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context,
               max(CASE WHEN rank = 1 THEN text END) AS answer,
               max(CASE WHEN rank = 1 THEN CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END END) AS feedback
        FROM grid_scaled LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) m USING (config_id, query_id)
      LEFT JOIN grid_lat ON user_id = q.query_id // 1000000""",
            "measured": ROWS["measured"], "scored": ROWS["scored"], "summary": SUMMARY_OF.replace("__rows", "scored")}


GRID = _grid_sql()
_GRID_SUBSET = {**GRID, **{n: _SUBSET[n] for n in ("picked_q", "rest_q", "subset_q", "first_summary", "chosen_c", "second_summary")},
                "numbered_q": _SUBSET["numbered_q"].replace("'benchmark'", "'conversations'").replace("FROM queries", "FROM qa")}


def grid_configs(t):
    """Five pipelines, three chunk sizes and two rerank depths with the one encoder there is."""
    return E.config_grid(t.spark, depths=GRID_DEPTHS).filter(F.col("embedding_model") == V.GRID_MODELS[0]).withColumn("top_k", F.lit(GRID_K))


def grid_scored(t):
    """Stored: evaluation rows of the grid against the assistant's answers."""
    configs = grid_configs(t)
    questions = cut_lineage(t.qa.select("query_id", F.col("question").alias("query"), F.col("answer").alias("expected")))
    docs = t.documents.select("doc_id", "source", T.text_of("text").alias("text"))
    hits = grid.grid_hits(docs, questions.select("query_id", "query"), configs)
    # a conversation has the mean time of the user with its number
    latency = latency_of(t).withColumnRenamed("query_id", "user_id")
    latency = questions.select("query_id", F.floor(F.col("query_id") / 1_000_000).alias("user_id")).join(latency, "user_id").drop("user_id")
    feedback = t.labels.select("doc_id", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("feedback"))
    return cut_lineage(E.score_rows(E.config_rows(questions, hits, configs, latency, feedback), "expected"))


@query("v12_grid_summary", Q.sql("SELECT * FROM summary", **GRID))
def _(t):
    return E.summarise_configs(grid_scored(t))


@query("v14_grid_two_phase", Q.sql(f"SELECT config_id, {OVERALL} AS phase_two, phase_one, position FROM second_summary JOIN chosen_c USING (config_id)", **_GRID_SUBSET))
def _(t):
    scored = grid_scored(t)
    questions = t.qa.select(F.lit("conversations").alias("source"), "query_id")
    return E.two_phase(scored, E.stratified_subset(questions, F.floor(F.col("query_id") / 1_000_000_000)))


@query("v15_grid_leaderboard", Q.sql(f"""
    SELECT config_id, {SUCCESS} AS score, avg_composite, avg_latency, success_rate, rank() OVER (ORDER BY {SUCCESS} DESC)::INT AS rank
    FROM summary ORDER BY score DESC, config_id LIMIT 10""", **GRID))
def _(t):
    return E.leaderboard(cut_lineage(E.summarise_configs(grid_scored(t))), 10)


# --- expected content ---------------------------------------------------------------------------

@query("v16_content_relevance", Q.sql("""
    SELECT query_id, round(accuracy + 1e-9, 6) AS accuracy, round(rel + 1e-9, 6) AS relevance, round(ranking + 1e-9, 6) AS ranking,
           round(0.5 * accuracy + 0.3 * rel + 0.2 * ranking + 1e-9, 6) AS overall FROM (
      SELECT query_id, least(1, 0.7 * avg(kw) + 0.3 * avg(cx)) AS rel, sum((req * 0.5 + 0.3 * kw + 0.2 * cx) / rank) / sum(1.0 / rank) AS ranking FROM (
        SELECT query_id, rank, max((kind = 'required' AND found)::INT) AS req, coalesce(avg(found::INT) FILTER (kind = 'keyword'), 0) AS kw,
               coalesce(avg(found::INT) FILTER (kind = 'context'), 0) AS cx FROM judged GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT query_id, avg(f) AS accuracy FROM (
      SELECT query_id, phrase, max(found::INT) AS f FROM judged WHERE kind = 'required' GROUP BY 1, 2) GROUP BY 1) USING (query_id)""", **CONTENT))
def _(t):
    return E.content_relevance(shown_of(t), expectations_of(t))


@query("v17_bridging_score", Q.sql("""
    SELECT query_id, round(s + 1e-9, 6) AS score, s > 0.3 AS success, fr AS required_found, fk AS keywords_found FROM (
      SELECT *, 0.7 * fr / (nr * 5) + 0.3 * CASE WHEN nk = 0 THEN 0 ELSE fk::DOUBLE / (nk * 5) END AS s FROM (
        SELECT query_id, count(*) FILTER (kind = 'required' AND found) AS fr, count(*) FILTER (kind = 'keyword' AND found) AS fk
        FROM judged WHERE rank <= 5 GROUP BY 1)
      JOIN (SELECT query_id, count(*) FILTER (kind = 'required') AS nr, count(*) FILTER (kind = 'keyword') AS nk FROM expected GROUP BY 1) USING (query_id))""", **CONTENT))
def _(t):
    return E.bridging_score(shown_of(t), expectations_of(t))


@query("v18_relevance_level", Q.sql("""
    SELECT query_id, indicators, CASE WHEN NOT has THEN 'NO_CONTENT' WHEN indicators >= 3 THEN 'HIGH' WHEN indicators >= 2 THEN 'MEDIUM'
           WHEN indicators >= 1 THEN 'LOW' ELSE 'POOR' END AS level, missing FROM (
      SELECT query_id, count(*) FILTER (found) AS indicators, bool_or(has) AS has,
             coalesce(string_agg(phrase, ',' ORDER BY phrase) FILTER (NOT found), '') AS missing FROM told GROUP BY 1)""", **CONTENT))
def _(t):
    return E.relevance_level(contexts_of(t), expectations_of(t))


_TOPICS = """
    SELECT *, CASE WHEN coverage >= 0.6 THEN 'GOOD' WHEN coverage >= 0.4 THEN 'PARTIAL' ELSE 'POOR' END AS assessment FROM (
      SELECT query_id, round(avg((contains(c, p) OR contains(c, replace(p, ' ', '')) OR contains(c, replace(p, '-', ' ')) OR contains(c, replace(p, '_', ' ')))::INT) + 1e-9, 6) AS coverage
      FROM (SELECT query_id, lower(context) AS c, lower(phrase) AS p FROM ctx JOIN expected USING (query_id)) GROUP BY 1)"""


@query("v19_topic_coverage", Q.sql(_TOPICS, **CONTENT))
def _(t):
    return E.topic_coverage(contexts_of(t), expectations_of(t))


@query("v19_ranking_metrics", Q.sql("""
    SELECT round(count(*)::DOUBLE / (SELECT count(*) FROM queries) + 1e-9, 6) AS success_rate, round(avg(coverage) + 1e-9, 6) AS avg_coverage,
           round(stddev_pop(coverage) + 1e-9, 6) AS coverage_std, round(avg((assessment = 'GOOD')::INT) + 1e-9, 6) AS good_rate,
           round(avg((assessment IN ('GOOD', 'PARTIAL'))::INT) + 1e-9, 6) AS partial_or_better FROM topics""", topics=_TOPICS, **CONTENT))
def _(t):
    return E.ranking_metrics(E.topic_coverage(contexts_of(t), expectations_of(t)), t.queries)


@query("v20_weighted_model_score", Q.sql(f"""
    SELECT *, CASE WHEN score >= 0.8 THEN 'EXCELLENT' WHEN score >= 0.6 THEN 'GOOD' WHEN score >= 0.4 THEN 'FAIR' WHEN score >= 0.2 THEN 'POOR' ELSE 'FAILED' END AS band FROM (
      {' UNION ALL '.join(f"SELECT config_id, '{f}' AS family, round({' + '.join(f'{w} * {m}' for m, w in ws.items())} + 1e-9, 6) AS score FROM (SELECT *, greatest(0, 1 - avg_latency) AS speed FROM summary)" for f, ws in E.WEIGHTS.items())})""", **CONFIGS))
def _(t):
    return E.weighted_scores(E.summarise_configs(scored_of(t)))


_FOUND = """
    SELECT *, CASE WHEN found >= 2 THEN 'GOOD_RELEVANCE' WHEN found = 1 THEN 'PARTIAL_RELEVANCE' ELSE 'POOR_RELEVANCE' END AS assessment FROM (
      SELECT query_id, count(*) FILTER (f) AS found, coalesce(string_agg(phrase, ',' ORDER BY phrase) FILTER (f), '') AS phrases FROM (
        SELECT query_id, phrase, bool_or(found) AS f FROM judged GROUP BY 1, 2) GROUP BY 1)"""


@query("v21_expected_content_found", Q.sql(_FOUND, **CONTENT))
def _(t):
    return E.expected_content_found(shown_of(t), expectations_of(t))


@query("v21_success_rates", Q.sql("""
    SELECT *, CASE WHEN success_rate >= 0.8 THEN 'EXCELLENT' WHEN success_rate >= 0.6 THEN 'GOOD' WHEN success_rate >= 0.4 THEN 'PARTIAL' ELSE 'POOR' END AS band,
           success_rate >= 0.75 AS handles_natural_language FROM (
      SELECT round(count(*) FILTER (found >= 2)::DOUBLE / (SELECT count(*) FROM queries) + 1e-9, 6) AS success_rate,
             round(count(*) FILTER (found >= 1)::DOUBLE / (SELECT count(*) FROM queries) + 1e-9, 6) AS found_rate FROM content_found)""", content_found=_FOUND, **CONTENT))
def _(t):
    return E.success_rates(E.expected_content_found(shown_of(t), expectations_of(t)), t.queries)


_VEC_CTX = Q.context_sql("(SELECT query_id, rank, source, text FROM vec10 JOIN chunks USING (chunk_id))", 6000)
GAPS = {**LOGS, "ctx": _VEC_CTX, "told": CONTENT["told"], "should": CONTENT["should"], "gaps": """
    SELECT * FROM (
      SELECT query_id, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (r IS NULL), '') AS missing_chunks,
             count(*) FILTER (r IS NULL) AS n_missing, round(100 * avg((r IS NOT NULL)::INT) + 1e-9, 6) AS coverage_pct
      FROM should LEFT JOIN (SELECT query_id, chunk_id, rank AS r FROM vec10) USING (query_id, chunk_id) GROUP BY 1)
    LEFT JOIN (SELECT query_id, coalesce(string_agg(phrase, ',' ORDER BY phrase) FILTER (NOT found), '') AS missing_areas FROM told GROUP BY 1) USING (query_id)""",
        "vec_best": "SELECT query_id, text AS answer FROM vec10 JOIN chunks USING (chunk_id) WHERE rank = 1"}


def gaps_of(t):
    t.store()
    hits = t.vector_hits(10)
    contexts = fusion.assemble_context(fusion.with_text(hits, t.chunks), 6000)
    return E.gap_analysis(t.bm25_hits(3), hits, contexts, expectations_of(t))


@query("v22_gap_analysis", Q.sql("SELECT * FROM gaps", **GAPS))
def _(t):
    return gaps_of(t)


@query("v23_user_impact", Q.sql("""
    SELECT query_id, l > 100 AND m <= 1 AS can_complete, CASE WHEN l <= 100 THEN 0.0 WHEN m = 0 THEN 0.9 WHEN m = 1 THEN 0.7 ELSE 0.3 END AS confidence,
           CASE WHEN l <= 100 THEN 'high' WHEN m = 0 THEN 'low' WHEN m = 1 THEN 'medium' ELSE 'high' END AS frustration_risk,
           CASE WHEN l <= 100 THEN 0.0 WHEN m = 0 THEN 0.85 WHEN m = 1 THEN 0.65 ELSE 0.25 END AS success_probability
    FROM (SELECT query_id, length(answer) AS l, n_missing AS m FROM gaps JOIN vec_best USING (query_id))""", **GAPS))
def _(t):
    gaps = gaps_of(t)
    best = fusion.with_text(t.vector_hits(1), t.chunks).select("query_id", F.length("text").alias("n"))
    return gaps.join(best, "query_id").select("query_id", *E.user_impact(F.col("n"), F.col("n_missing")))


_TOOLS, _SUBJECT = ["tion", "ment"], ["ein", "the"]


@query("v24_answer_indicators", Q.sql(rf"""
    SELECT query_id, round(c + 1e-9, 6) AS completeness, round(a + 1e-9, 6) AS actionability, round(v + 1e-9, 6) AS value,
           CASE WHEN length(answer) < 50 THEN 'none' WHEN v >= 0.8 THEN 'high' WHEN v >= 0.6 THEN 'moderate' WHEN v >= 0.4 THEN 'low' ELSE 'minimal' END AS value_band
    FROM (SELECT query_id, answer,
        ({Q.any_of('low', V.STEP_WORDS)}::INT + {Q.any_of('low', _TOOLS)}::INT + {Q.any_of('low', V.ACTION_WORDS)}::INT + (length(answer) > 300)::INT + {Q.any_of('low', V.CONTACT_WORDS)}::INT) / 5.0 AS c,
        ((contains(answer, ':') AND {Q.any_of('answer', ['.', ';'])})::INT + {Q.any_of('low', V.PROCEDURE_WORDS)}::INT + {Q.any_of('low', V.TOOL_VERBS)}::INT
          + (length(answer) - length(replace(answer, chr(10), '')) > 2 OR {Q.any_of('answer', ['1.', '2.', '3.'])})::INT + {Q.any_of('low', V.OUTCOME_WORDS)}::INT) / 5.0 AS a,
        CASE WHEN length(answer) < 50 THEN 0.0 ELSE (({Q.overlap('question', 'answer')} > 0.3)::INT + (length(answer) > 200)::INT
          + (NOT {Q.any_of('low', V.UNSURE_WORDS)})::INT + {Q.any_of('low', _SUBJECT)}::INT) / 4.0 END AS v
      FROM (SELECT *, lower(answer) AS low FROM qa WHERE answer <> ''))"""))
def _(t):
    cols = E.answer_indicators(F.col("question"), F.col("answer"), _TOOLS, _SUBJECT)
    df = t.qa.select("query_id", *cols)
    return df.select("query_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("completeness", "actionability", "value")], "value_band")


@query("v25_parameter_sweep", Q.sql(f"""
    SELECT threshold, top_k, round(avg(0.4 * cov + 0.3 * done::INT + 0.2 * prob + 0.1 * conf) + 1e-9, 6) AS success, round(100 * avg(cov) + 1e-9, 6) AS coverage_pct,
           round(avg(done::INT) + 1e-9, 6) AS completion_rate, count(*) FILTER (cov >= 1) AS fully_covered FROM (
      SELECT threshold, top_k, covered::DOUBLE / n AS cov, l > 100 AND n - covered <= 1 AS done,
             CASE WHEN l <= 100 THEN 0.0 WHEN n = covered THEN 0.85 WHEN n - covered = 1 THEN 0.65 ELSE 0.25 END AS prob,
             CASE WHEN l <= 100 THEN 0.0 WHEN n = covered THEN 0.9 WHEN n - covered = 1 THEN 0.7 ELSE 0.3 END AS conf FROM (
        SELECT q.query_id, threshold, top_k, count(s.chunk_id) AS covered, any_value(e.n) AS n,
               coalesce(max(CASE WHEN h.rank = 1 THEN length(c.text) END), 0) AS l
        FROM queries q CROSS JOIN (SELECT unnest({E.SWEEP_THRESHOLDS})::DOUBLE AS threshold) CROSS JOIN (SELECT unnest({E.SWEEP_TOP_K}) AS top_k)
        JOIN (SELECT query_id, count(*) AS n FROM should GROUP BY 1) e ON e.query_id = q.query_id
        LEFT JOIN vec50 h ON h.query_id = q.query_id AND h.rank <= top_k AND h.score >= threshold
        LEFT JOIN chunks c ON c.chunk_id = h.chunk_id
        LEFT JOIN should s ON s.query_id = h.query_id AND s.chunk_id = h.chunk_id GROUP BY 1, 2, 3))
    GROUP BY 1, 2""", should=CONTENT["should"], vec50=Q.ranked("vec", 50)))
def _(t):
    t.store()
    return E.parameter_sweep(t.queries, fusion.with_text(t.vector_hits(50), t.chunks), t.bm25_hits(3))


_LONG = " UNION ALL ".join(f"SELECT config_id, plan, k, '{m}' AS metric, {m}::DOUBLE AS value FROM summary" for m in E.METRICS)
_STATS = "count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(stddev_samp(value) + 1e-9, 6) AS std, min(value) AS min_value, max(value) AS max_value"


@query("v26_metric_stats", Q.sql(f"SELECT metric, {_STATS} FROM long_m GROUP BY 1", **CONFIGS, long_m=_LONG))
def _(t):
    return E.metric_stats(E.summarise_configs(scored_of(t)))


@query("v26_top_by_metric", Q.sql("""
    SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'avg_latency' THEN -value ELSE value END DESC, config_id)::INT AS rank,
           config_id, value FROM long_m QUALIFY rank <= 3""", **CONFIGS, long_m=_LONG))
def _(t):
    return E.top_by_metric(E.summarise_configs(scored_of(t)))


@query("v26_stats_by_parameter", Q.sql(f"""
    SELECT parameter, setting, metric, {_STATS} FROM (
      SELECT 'engine' AS parameter, plan AS setting, metric, value FROM long_m UNION ALL SELECT 'top_k', k::VARCHAR, metric, value FROM long_m)
    GROUP BY 1, 2, 3""", **CONFIGS, long_m=_LONG))
def _(t):
    return E.stats_by_parameter(E.summarise_configs(scored_of(t)))


@query("v27_spot_check_sample", Q.sql("""
    SELECT seq, config_id, query_id, composite, round(recent + 1e-9, 6) AS recent, reason FROM (
      SELECT *, CASE WHEN seq >= 10 AND composite > recent + 0.2 THEN 'high' WHEN seq >= 10 AND composite < recent - 0.3 THEN 'low'
                     WHEN (seq - 1) % 20 = 0 THEN 'systematic' END AS reason FROM (
        SELECT *, row_number() OVER (ORDER BY config_id, query_id) AS seq,
               avg(composite) OVER (ORDER BY config_id, query_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS recent FROM scored))
    WHERE reason IS NOT NULL""", **ROWS))
def _(t):
    return E.spot_check_sample(scored_of(t), "config_id", "query_id")


@query("v28_engine_insights", Q.sql(f"""
    SELECT family, count(*) AS configs, round(avg(score) + 1e-9, 6) AS avg_score, round(max(score) - min(score) + 1e-9, 6) AS gap, round(sum(seconds) + 1e-9, 6) AS seconds FROM (
      SELECT CASE WHEN contains(plan, 'hybrid') THEN 'hybrid' WHEN contains(plan, 'vector') THEN 'vector' WHEN contains(plan, 'rerank') THEN 'reranking' ELSE 'other' END AS family,
             {SUCCESS} AS score, avg_latency * n AS seconds FROM summary) GROUP BY 1""", **CONFIGS))
def _(t):
    return E.engine_insights(E.summarise_configs(scored_of(t)))


@query("v29_recommendations", Q.sql("""
    SELECT config_id, unnest(list_filter([
        CASE WHEN hit_rate < 0.8 THEN 'coverage below 80 %: more results or a lower threshold' END,
        CASE WHEN success_rate < 0.7 THEN 'success below .7: completeness first' END, CASE WHEN k < 5 THEN 'very few chunks' END,
        CASE WHEN k > 50 THEN 'too many chunks' END, CASE WHEN avg_latency > 2 * (SELECT avg(avg_latency) FROM summary) THEN 'slow configuration' END,
        CASE WHEN avg_composite < 0.6 THEN 'context quality could be better' END], lambda x: x IS NOT NULL)) AS advice FROM summary""", **CONFIGS))
def _(t):
    return E.recommendations(summary_of(t))


@query("v30_section_coverage", Q.sql("""
    SELECT *, round(100.0 * covered / sections + 1e-9, 6) AS coverage_pct, covered >= 0.9 * sections AS meets_target FROM (
      SELECT query_id, count(*) AS sections, count(*) FILTER (f >= 0.7 * n) AS covered, sum(f)::BIGINT AS phrases_found FROM (
        SELECT query_id, kind, count(*) AS n, count(*) FILTER (found) AS f FROM told GROUP BY 1, 2) GROUP BY 1)""", **CONTENT))
def _(t):
    return E.section_coverage(contexts_of(t), expectations_of(t))


GATE = {**CONTENT, "lat": ROWS["lat"], "gate": f"""
    SELECT *, score >= 0.7 AND content >= 0.5 AND latency < 10 AS ready FROM (
      SELECT query_id, content, latency, round(0.6 * content + 0.4 * (length(answer) > 50 AND content > 0 AND len({Q.tokens('answer')}) > 10)::INT + 1e-9, 6) AS score FROM (
        SELECT query_id, answer, latency, round(avg(contains(lower(answer), lower(phrase))::INT) + 1e-9, 6) AS content FROM (
          SELECT query_id, answer, coalesce(latency, 0) AS latency FROM bm_best LEFT JOIN (SELECT query_id, latency FROM lat WHERE plan = 'bm25') USING (query_id))
        JOIN expected USING (query_id) GROUP BY 1, 2, 3))"""}


def gate_of(t):
    answers = shown_of(t).filter("rank = 1").join(latency_of(t), "query_id", "left").select(
        "query_id", F.col("text").alias("answer"), F.coalesce("latency", F.lit(0.0)).alias("latency"))
    return E.answer_gate(answers, expectations_of(t))


@query("v31_answer_gate", Q.sql("SELECT query_id, content, score, ready FROM gate", **GATE))
def _(t):
    return gate_of(t).select("query_id", "content", "score", "ready")


@query("v31_release_gate", Q.sql("""
    SELECT *, critical_ready_rate >= 0.8 AND ready_rate >= 0.67 AND avg_latency < 8 AND avg_score >= 0.6 AS release FROM (
      SELECT count(*) AS queries, round(avg(score) + 1e-9, 6) AS avg_score, round(avg(latency) + 1e-9, 6) AS avg_latency, round(avg(ready::INT) + 1e-9, 6) AS ready_rate,
             round(coalesce(avg(ready::INT) FILTER (length(query) > 200), 1.0) + 1e-9, 6) AS critical_ready_rate FROM gate JOIN queries USING (query_id))""", **GATE))
def _(t):
    return E.release_gate(gate_of(t).join(t.queries, "query_id"), F.length("query") > 200)


@query("v32_current_leaders", Q.sql("""
    SELECT category, config_id, score FROM (
      SELECT 'best_overall' AS category, config_id, round(0.4 * hit_rate + 0.4 * avg_correctness + 0.2 * success_rate + 1e-9, 6) AS score FROM summary UNION ALL
      SELECT 'highest_quality', config_id, round((hit_rate + avg_correctness) / 2 + 1e-9, 6) FROM summary UNION ALL
      SELECT 'most_accurate', config_id, avg_correctness FROM summary UNION ALL SELECT 'most_reliable', config_id, success_rate FROM summary)
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, config_id) = 1""", **CONFIGS))
def _(t):
    return E.current_leaders(E.summarise_configs(scored_of(t)))


@query("v32_running_averages", Q.sql(f"""
    SELECT config_id, row_number() OVER (ORDER BY config_id)::INT AS checkpoint,
           {', '.join(f"round(avg({c}) OVER (ORDER BY config_id) + 1e-9, 6) AS running_{c}" for c in ("hit_rate", "avg_correctness", "success_rate", "avg_latency"))}
    FROM summary""", **CONFIGS))
def _(t):
    return E.running_averages(summary_of(t))
