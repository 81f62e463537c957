"""Evaluation of retrieval and answers over (question x configuration) tables.

eval rows  = (config_id, plan, k, query_id, query, expected, answer, context, latency, similarity, feedback)
expected   = (query_id, kind, phrase): what a good answer holds
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V, scores as S, text as T
from ..session import cut_lineage
from .checks import retrieval_succeeded  # noqa: F401  (part of this module's interface)


# --- questions and configurations ------------------------------------------------------------

def validate_qa(qa: DataFrame, asks_for_source: list[str], source_marks: list[str]) -> DataFrame:
    """(query_id, issue): deflecting answers, short answers to long questions, answers without a source mark."""
    answer, question = F.lower("answer"), F.lower("question")
    issues = F.array_compact(F.array(
        *[F.when(F.contains(answer, F.lit(p.lower())), f"generic: {p}") for p in V.GENERIC_ANSWERS],
        F.when((F.length("question") > 100) & (F.length("answer") < 30), "short answer to a long question"),
        F.when(T.contains_any(question, asks_for_source) & ~T.contains_any(answer, source_marks), "no source mark")))
    return qa.select("query_id", F.explode(issues).alias("issue"))


def stratified_subset(questions: DataFrame, slices: Column, low: int = 8, high: int = 12) -> DataFrame:
    """First, middle and last question of every source, at most ``high``; topped up to ``low`` at even
    steps from the rest. Fewer than ``low`` questions are all taken."""
    df = S.numbered(questions, "query_id", slices, to="pos", keys=("source",))
    sizes = cut_lineage(questions.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    df = cut_lineage(df.join(sizes, "source"))
    first_mid_last = F.array_distinct(F.when(F.col("n") >= 3, F.array(F.lit(1), F.floor(F.col("n") / 2) + 1, F.col("n")))
                                      .otherwise(F.array(F.lit(1), F.col("n"))))
    df = df.withColumn("_pick", F.array_contains(first_mid_last, F.col("pos")) | F.lit(total < low))
    picked = cut_lineage(df.filter("_pick").orderBy("source", "pos").limit(high))  # a cap that is part of the operator
    chosen = picked.count()
    needed = min(low - chosen, total - chosen)
    if needed <= 0:
        return picked.select("source", "query_id", "pos")
    step = max(1, (total - chosen) // needed)
    rest = df.filter(~F.col("_pick")).withColumn("_o", F.struct("source", "pos"))
    rest = S.numbered(rest, "_o", F.struct("source", F.floor(F.col("pos") / 10_000)), to="_r")
    more = rest.filter(((F.col("_r") - 1) % step == 0) & (F.floor((F.col("_r") - 1) / step) < high - chosen))
    return picked.select("source", "query_id", "pos").unionByName(more.select("source", "query_id", "pos"))


def config_grid(spark, chunk_sizes=V.GRID_CHUNK_SIZES, depths=V.GRID_RERANK_DEPTHS) -> DataFrame:
    """All combinations of the grid axes; other parameters are fixed."""
    def axis(values: list) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))
    df = spark.range(1).select(axis(V.GRID_MODELS).alias("embedding_model"))
    df = df.select("*", axis(chunk_sizes).alias("chunk_size")).select("*", axis(depths).alias("rerank_top_k"))
    return df.select("*", axis(V.PLAN_NAMES).alias("plan")).select(
        F.concat_ws("/", "embedding_model", "chunk_size", "rerank_top_k", "plan").alias("config_id"), "*",
        F.lit(20).alias("top_k"), F.lit(0.25).alias("similarity_threshold"), F.lit(0.5).alias("sparse_weight"),
        F.lit(150).alias("expansion_k"), F.lit(512).alias("max_sparse_length"))


def config_sample(spark, n: int, seed: int) -> DataFrame:
    """``n`` configurations with every axis chosen by a hash of (number, axis, seed): the same on any
    number of partitions."""
    def pick(name: str, values: list) -> Column:
        at = F.pmod(F.xxhash64(F.col("id"), F.lit(name), F.lit(seed)), F.lit(len(values))).cast("int") + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), at).alias(name)

    return spark.range(n).select(
        F.concat(F.lit("RAND_"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("config_id"),
        pick("embedding_model", V.GRID_MODELS), pick("chunk_size", V.SAMPLE_CHUNK_SIZES), pick("plan", V.PLAN_NAMES),
        pick("rerank_top_k", V.SAMPLE_RERANK_DEPTHS), pick("top_k", V.SAMPLE_TOP_K),
        pick("expansion_k", V.SAMPLE_EXPANSION), pick("max_sparse_length", V.SAMPLE_SPARSE_LENGTHS),
        pick("similarity_threshold", [round(0.15 + 0.01 * i, 2) for i in range(26)]),
        pick("sparse_weight", [round(0.2 + 0.1 * i, 1) for i in range(7)]))


def with_chunk_load(configs: DataFrame, docs: DataFrame, overlap: int = 0) -> DataFrame:
    """Configurations with the number of chunks each would build; one pass over the document sizes."""
    sizes = configs.select("chunk_size").distinct()
    wanted = F.collect_set("chunk_size")
    per_size = docs.select("n_chars", F.explode(sizes.agg(wanted).scalar()).alias("chunk_size"))
    load = per_size.groupBy("chunk_size").agg(F.sum(F.ceil(F.col("n_chars") / (F.col("chunk_size") - overlap))).alias("chunks"))
    return configs.join(load, "chunk_size")


# --- rows -------------------------------------------------------------------------------------

def eval_rows(queries: DataFrame, hits: DataFrame, latency: DataFrame, feedback: DataFrame, ks: list[int],
              plans: list[str]) -> DataFrame:
    """One row per (configuration, question); a configuration is a plan and a depth k.

    ``hits`` = (plan, query_id, chunk_id, doc_id, score, rank, text) is retrieved once at the greatest
    depth; every smaller depth reads the same hits.
    """
    best = F.max("score").over(Window.partitionBy("plan", "query_id"))
    depth = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    per_k = (hits.withColumn("_s", F.when(best > 0, F.col("score") / best).otherwise(0.0))
             .join(feedback, "doc_id", "left").withColumn("k", F.explode(depth)))
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    made = per_k.groupBy("plan", "k", "query_id").agg(
        parts.alias("p"), F.avg("_s").alias("similarity"),
        F.max(F.when(F.col("rank") == 1, F.col("feedback"))).alias("feedback"))
    made = made.select("plan", "k", "query_id", "similarity", "feedback", F.col("p")[0]["text"].alias("answer"),
                       F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("context"))
    asked = queries.select("query_id", "query", F.explode(F.array(*[F.lit(p) for p in plans])).alias("plan"))
    asked = asked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    df = (asked.join(made, ["plan", "k", "query_id"], "left").join(latency, ["plan", "query_id"], "left"))
    return df.select(F.concat_ws("-", "plan", "k").alias("config_id"), "plan", "k", "query_id", "query", "answer", "context",
                     F.coalesce("latency", F.lit(0.0)).alias("latency"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
                     F.coalesce("feedback", F.lit("neutral")).alias("feedback"), F.col("answer").isNull().alias("error"))


def composite(correct: Column, complete: Column, recall: Column, latency: Column) -> Column:
    c = (0.5 * correct.cast("double") + 0.2 * complete + 0.2 * recall + 0.1 * (1 - F.least(latency / 2.0, F.lit(1.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def config_rows(questions: DataFrame, hits: DataFrame, configs: DataFrame, latency: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per (configuration, question with its expected answer), from the hits of every configuration.

    ``hits`` = (config_id, query_id, doc_id, score, rank, text); ``configs`` = (config_id, plan, top_k) are few and cross the questions.
    """
    best = F.max("score").over(Window.partitionBy("config_id", "query_id"))
    scaled = hits.withColumn("_s", F.when(best > 0, F.col("score") / best).otherwise(0.0)).join(feedback, "doc_id", "left")
    made = scaled.groupBy("config_id", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"), F.avg("_s").alias("similarity"),
        F.max(F.when(F.col("rank") == 1, F.col("feedback"))).alias("feedback"))
    made = made.select("config_id", "query_id", "similarity", "feedback", F.col("p")[0]["text"].alias("answer"),
                       F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("context"))
    each = F.explode(F.array(*[F.struct(F.lit(r["config_id"]).alias("config_id"), F.lit(r["plan"]).alias("plan"), F.lit(r["top_k"]).alias("k"))
                               for r in configs.select("config_id", "plan", "top_k").collect()]))
    asked = questions.select("query_id", "query", "expected", each.alias("c")).select("query_id", "query", "expected", "c.*")
    df = asked.join(made, ["config_id", "query_id"], "left").join(latency, "query_id", "left")
    return df.select("config_id", "plan", "k", "query_id", "query", "expected", "answer", "context",
                     F.coalesce("latency", F.lit(0.0)).alias("latency"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
                     F.coalesce("feedback", F.lit("neutral")).alias("feedback"), F.col("answer").isNull().alias("error"))


def score_rows(rows: DataFrame, expected: str = "query") -> DataFrame:
    """Adds correctness, completeness, specificity, recall, context hit and the composite score. ``expected`` names the column of
    the expected answer; by default it is the question's own passage."""
    answer, context = F.coalesce("answer", F.lit("")), F.coalesce("context", F.lit(""))
    df = rows.select("*", F.round(T.word_overlap(F.col(expected), answer) + 1e-9, 6).alias("correctness"),
                     T.completeness_by_length(answer).alias("completeness"),
                     F.round(T.specificity(answer) + 1e-9, 6).alias("specificity"),
                     F.round(T.word_overlap(F.col(expected), context) + 1e-9, 6).alias("recall"))
    df = df.withColumn("correct", F.col("correctness") >= 0.5).withColumn("context_hit", F.col("recall") >= 0.3)
    return df.withColumn("composite", F.round(composite(
        F.col("correct"), F.col("completeness"), F.col("recall"), F.col("latency")) + 1e-9, 6)).drop("query", "expected", "answer", "context")


def fact_f1(answer: Column, expected: Column) -> Column:
    """F1 of the fact sets; 0 without texts, 1 if nothing is expected."""
    def score(a: Column, e: Column) -> Column:
        both = F.size(F.array_intersect(a, e))
        return F.when(F.size(e) == 0, 1.0).otherwise(T.ratio(2.0 * both, F.size(a) + F.size(e)))
    return F.when((answer == "") | (expected == "") | (answer == "ERROR"), 0.0).otherwise(
        T.let(T.extract_facts(answer), lambda a: T.let(T.extract_facts(expected), lambda e: score(a, e))))


def fact_recall(context: Column, expected: Column) -> Column:
    return F.when((context == "") | (expected == ""), 0.0).otherwise(T.let(
        T.extract_facts(expected), lambda e: F.when(F.size(e) == 0, 1.0).otherwise(
            F.size(F.array_intersect(e, T.extract_facts(context))) / F.size(e))))


def semantic_answer_score(question: Column, expected: Column, answer: Column, context: Column, text: Column) -> Column:
    """.4 likeness to the expected answer + .3 to the question + .2 to the context + .1 length; arguments
    are vectors and the answer's text."""
    return F.when((text == "") | F.startswith(text, F.lit("ERROR")), 0.0).otherwise(
        0.4 * S.cosine(expected, answer) + 0.3 * S.cosine(question, answer) + 0.2 * S.cosine(context, answer)
        + 0.1 * F.least(F.length(text) / 100.0, F.lit(1.0)))


# --- configurations ---------------------------------------------------------------------------

def summarise_configs(scored: DataFrame) -> DataFrame:
    """Per configuration: averages over the rows without error and rates."""
    ok = ~F.col("error")

    def mean(c: Column, to: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0)) + 1e-9, 6).alias(to)

    return scored.groupBy("config_id", "plan", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")) + 1e-9, 6).alias("success_rate"),
        mean(F.col("latency"), "avg_latency"), mean(F.col("similarity"), "avg_similarity"),
        mean(F.col("context_hit").cast("double"), "hit_rate"), mean(F.col("correctness"), "avg_correctness"),
        mean(F.col("completeness"), "avg_completeness"), mean(F.col("specificity"), "avg_specificity"),
        mean(F.col("composite"), "avg_composite"),
        *[mean((F.col("feedback") == f).cast("double"), f"{f}_rate") for f in ("positive", "negative", "neutral")])


def overall_score() -> Column:
    """.3 hit + .25 correct + .1 complete + .05 specific + .2 success + speed bonus, at most 1."""
    speed = F.least(F.lit(0.1), 0.2 / F.greatest(F.col("avg_latency"), F.lit(0.1)))
    total = (0.3 * F.col("hit_rate") + 0.25 * F.col("avg_correctness") + 0.1 * F.col("avg_completeness")
             + 0.05 * F.col("avg_specificity") + 0.2 * F.col("success_rate") + speed)
    return F.round(F.least(F.lit(1.0), total) + 1e-9, 6)


def success_score() -> Column:
    return F.round(0.6 * F.col("avg_composite") + 0.4 * F.col("avg_similarity") + 1e-9, 6)


def best_configs(summary: DataFrame, n: Column | int, score: str = "score") -> DataFrame:
    """The best ``n`` of a table of configurations. Configurations are few (the size of the grid)."""
    w = Window.orderBy(F.desc(score), "config_id")
    return summary.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def two_phase(scored: DataFrame, subset: DataFrame, share: float = 0.3) -> DataFrame:
    """Score all configurations on a subset of the questions, the best 30 % (at least one) on all."""
    first = cut_lineage(summarise_configs(scored.join(subset.select("query_id"), "query_id", "left_semi")).select(
        "config_id", overall_score().alias("score")))
    chosen = best_configs(first, max(1, int(share * first.count() + 1e-9))).select("config_id", F.col("score").alias("phase_one"), "position")
    second = summarise_configs(scored.join(chosen.select("config_id"), "config_id", "left_semi"))
    return second.select("config_id", overall_score().alias("phase_two")).join(chosen, "config_id")


def leaderboard(summary: DataFrame, n: int) -> DataFrame:
    top = summary.select("config_id", success_score().alias("score"), "avg_composite", "avg_latency", "success_rate")
    return best_configs(top, n).withColumn("rank", F.rank().over(Window.orderBy(F.desc("score")))).drop("position")


WEIGHTS = {  # family: weight of each metric
    "core": {"avg_correctness": 0.7, "hit_rate": 0.2, "speed": 0.1},
    "semantic": {"avg_composite": 0.5, "avg_correctness": 0.3, "hit_rate": 0.2},
    "quality": {"avg_correctness": 0.32, "hit_rate": 0.24, "success_rate": 0.24, "speed": 0.2},
}


def weighted_scores(summary: DataFrame) -> DataFrame:
    """(config_id, family, score, band): one weight table joined with the metrics in long form."""
    table = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), F.lit(w).alias("weight"))
                      for f, ws in WEIGHTS.items() for m, w in ws.items()])
    speed = F.greatest(F.lit(0.0), 1 - F.col("avg_latency"))
    metrics = F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("avg_correctness", "hit_rate", "avg_composite", "success_rate", "speed")]),
        F.array("avg_correctness", "hit_rate", "avg_composite", "success_rate", speed))
    rows = summary.select("config_id", metrics.alias("m"), F.explode(table).alias("w"))
    out = rows.groupBy("config_id", F.col("w.family").alias("family")).agg(
        F.round(F.sum(F.col("w.weight") * F.element_at("m", F.col("w.metric"))) + 1e-9, 6).alias("score"))
    band = F.when(F.col("score") >= 0.8, "EXCELLENT").when(F.col("score") >= 0.6, "GOOD").when(
        F.col("score") >= 0.4, "FAIR").when(F.col("score") >= 0.2, "POOR").otherwise("FAILED")
    return out.withColumn("band", band)


METRICS = ["hit_rate", "avg_correctness", "avg_completeness", "avg_specificity", "avg_latency", "positive_rate"]


def _long(summary: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return summary.select("config_id", "plan", "k", F.explode(pairs).alias("x")).select("config_id", "plan", "k", "x.*")


def metric_stats(summary: DataFrame) -> DataFrame:
    return _stats(_long(summary), ["metric"])


def _stats(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value") + 1e-9, 6).alias("mean"), F.round(F.stddev_samp("value") + 1e-9, 6).alias("std"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def top_by_metric(summary: DataFrame, n: int = 3) -> DataFrame:
    """The best ``n`` configurations of every metric; for latency smaller is better."""
    better = F.when(F.col("metric") == "avg_latency", -F.col("value")).otherwise(F.col("value"))
    ranked = S.top_k(_long(summary).withColumn("_s", better), n, by="metric", score="_s", tie="config_id")
    return ranked.select("metric", "rank", "config_id", "value")


def stats_by_parameter(summary: DataFrame) -> DataFrame:
    """(parameter, setting, metric): mean, std and count per engine and per depth."""
    setting = F.array(F.struct(F.lit("engine").alias("parameter"), F.col("plan").alias("setting")),
                      F.struct(F.lit("top_k").alias("parameter"), F.col("k").cast("string").alias("setting")))
    long = _long(summary).withColumn("p", F.explode(setting)).select("p.*", "metric", "value")
    return _stats(long, ["parameter", "setting", "metric"])


def spot_check_sample(scored: DataFrame, *order: str) -> DataFrame:
    """Rows for a second look: every 20th in the order, and values far from the mean of the last 50. Rows are numbered in range parts."""
    df = S.with_range_parts(scored, *order).withColumn("_o", F.struct(*order))
    df = S.rolling_mean(S.numbered(df, "_o", F.col("_part")), "seq", "composite", 50, "recent")
    i = F.col("seq") - 1
    reason = (F.when((F.col("seq") >= 10) & (F.col("composite") > F.col("recent") + 0.2), "high")
              .when((F.col("seq") >= 10) & (F.col("composite") < F.col("recent") - 0.3), "low")
              .when(i % 20 == 0, "systematic"))
    return df.select("seq", "config_id", "query_id", "composite", F.round(F.col("recent") + 1e-9, 6).alias("recent"),
                     reason.alias("reason")).filter("reason is not null")


def engine_family(name: Column) -> Column:
    return (F.when(F.contains(name, F.lit("hybrid")), "hybrid").when(F.contains(name, F.lit("vector")), "vector")
            .when(F.contains(name, F.lit("rerank")), "reranking").otherwise("other"))


def engine_insights(summary: DataFrame) -> DataFrame:
    """Per engine family: configurations, mean score, gap of best and worst, total time."""
    df = summary.select(engine_family(F.col("plan")).alias("family"), success_score().alias("score"),
                        (F.col("avg_latency") * F.col("n")).alias("seconds"))
    return df.groupBy("family").agg(
        F.count(F.lit(1)).alias("configs"), F.round(F.avg("score") + 1e-9, 6).alias("avg_score"),
        F.round(F.max("score") - F.min("score") + 1e-9, 6).alias("gap"), F.round(F.sum("seconds") + 1e-9, 6).alias("seconds"))


def recommendations(summary: DataFrame) -> DataFrame:
    """(config_id, advice): one row per rule that fires."""
    mean_time = summary.agg(F.avg("avg_latency")).scalar()
    rules = F.array_compact(F.array(
        F.when(F.col("hit_rate") < 0.8, "coverage below 80 %: more results or a lower threshold"),
        F.when(F.col("success_rate") < 0.7, "success below .7: completeness first"),
        F.when(F.col("k") < 5, "very few chunks"), F.when(F.col("k") > 50, "too many chunks"),
        F.when(F.col("avg_latency") > 2 * mean_time, "slow configuration"),
        F.when(F.col("avg_composite") < 0.6, "context quality could be better")))
    return summary.select("config_id", F.explode(rules).alias("advice"))


def current_leaders(summary: DataFrame) -> DataFrame:
    """The configuration that leads each category."""
    categories = {
        "best_overall": 0.4 * F.col("hit_rate") + 0.4 * F.col("avg_correctness") + 0.2 * F.col("success_rate"),
        "highest_quality": (F.col("hit_rate") + F.col("avg_correctness")) / 2,
        "most_accurate": F.col("avg_correctness"), "most_reliable": F.col("success_rate")}
    pairs = F.array(*[F.struct(F.lit(n).alias("category"), F.round(c + 1e-9, 6).alias("score")) for n, c in categories.items()])
    long = summary.select("config_id", F.explode(pairs).alias("x")).select("config_id", "x.*")
    return S.top_k(long, 1, by="category", tie="config_id").select("category", "config_id", "score")


def running_averages(summary: DataFrame) -> DataFrame:
    """Averages over the configurations done so far, per checkpoint. One row per configuration."""
    w = Window.orderBy("config_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summary.select("config_id", F.row_number().over(Window.orderBy("config_id")).alias("checkpoint"),
                          *[F.round(F.avg(c).over(w) + 1e-9, 6).alias(f"running_{c}") for c in
                            ("hit_rate", "avg_correctness", "success_rate", "avg_latency")])


# --- expected content -------------------------------------------------------------------------

def hits_with_expected(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank, kind, phrase, found) for every hit and expected phrase of its query."""
    low = hits.select("query_id", "rank", F.lower("text").alias("_t"))
    return low.join(expected, "query_id").select(
        "query_id", "rank", "kind", "phrase", F.contains("_t", F.lower("phrase")).alias("found"))


def content_relevance(hits: DataFrame, expected: DataFrame, top: int = 10) -> DataFrame:
    """.5 share of required content + .3 keyword share + .2 position-weighted relevance."""
    df = hits_with_expected(hits.filter(F.col("rank") <= top), expected)

    def share(kind: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("found").cast("double"))), F.lit(0.0))

    per_hit = df.groupBy("query_id", "rank").agg(
        F.max(((F.col("kind") == "required") & F.col("found"))).alias("req"), share("keyword").alias("kw"),
        share("context").alias("cx"))
    per_hit = per_hit.withColumn("rel", F.col("req").cast("double") * 0.5 + 0.3 * F.col("kw") + 0.2 * F.col("cx"))
    ranking = per_hit.groupBy("query_id").agg(
        F.avg("kw").alias("kw"), F.avg("cx").alias("cx"),
        (F.sum(F.col("rel") / F.col("rank")) / F.sum(1.0 / F.col("rank"))).alias("ranking"))
    accuracy = (df.filter("kind = 'required'").groupBy("query_id", "phrase").agg(F.max("found").alias("f"))
                .groupBy("query_id").agg(F.avg(F.col("f").cast("double")).alias("accuracy")))
    relevance = F.least(F.lit(1.0), 0.7 * F.col("kw") + 0.3 * F.col("cx"))
    return ranking.join(accuracy, "query_id").select(
        "query_id", F.round(F.col("accuracy") + 1e-9, 6).alias("accuracy"), F.round(relevance + 1e-9, 6).alias("relevance"),
        F.round(F.col("ranking") + 1e-9, 6).alias("ranking"),
        F.round(0.5 * F.col("accuracy") + 0.3 * relevance + 0.2 * F.col("ranking") + 1e-9, 6).alias("overall"))


def bridging_score(hits: DataFrame, expected: DataFrame, top: int = 5) -> DataFrame:
    """.7 required + .3 keywords, each over ``top`` places; success above .3."""
    df = hits_with_expected(hits.filter(F.col("rank") <= top), expected)
    sizes = expected.groupBy("query_id").agg(F.count_if(F.col("kind") == "required").alias("nr"),
                                             F.count_if(F.col("kind") == "keyword").alias("nk"))
    found = df.groupBy("query_id").agg(F.count_if((F.col("kind") == "required") & F.col("found")).alias("fr"),
                                       F.count_if((F.col("kind") == "keyword") & F.col("found")).alias("fk"))
    score = 0.7 * T.ratio(F.col("fr"), F.col("nr") * top) + 0.3 * T.ratio(F.col("fk"), F.col("nk") * top)
    return found.join(sizes, "query_id").select(
        "query_id", F.round(score + 1e-9, 6).alias("score"), (score > 0.3).alias("success"),
        F.col("fr").alias("required_found"), F.col("fk").alias("keywords_found"))


def phrases_in_context(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, kind, phrase, found) against the whole context of each query."""
    return expected.join(contexts.select("query_id", F.lower("context").alias("_c")), "query_id", "left").select(
        "query_id", "kind", "phrase", F.coalesce(F.contains("_c", F.lower("phrase")), F.lit(False)).alias("found"),
        F.col("_c").isNotNull().alias("has_context"))


def relevance_level(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Level by the number of indicators found, with the missing ones."""
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("phrase")))), ",")
    df = phrases_in_context(contexts, expected).groupBy("query_id").agg(
        F.count_if("found").alias("indicators"), F.max("has_context").alias("has"), missing.alias("missing"))
    level = (F.when(~F.col("has"), "NO_CONTENT").when(F.col("indicators") >= 3, "HIGH").when(F.col("indicators") >= 2, "MEDIUM")
             .when(F.col("indicators") >= 1, "LOW").otherwise("POOR"))
    return df.select("query_id", "indicators", level.alias("level"), "missing")


def topic_coverage(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected topics in the context, allowing three other spellings; GOOD, PARTIAL or POOR."""
    p, c = F.lower("phrase"), F.col("_c")
    spellings = [p, F.replace(p, F.lit(" "), F.lit("")), F.replace(p, F.lit("-"), F.lit(" ")), F.replace(p, F.lit("_"), F.lit(" "))]
    hit = F.lit(False)
    for s in spellings:
        hit = hit | F.contains(c, s)
    df = (expected.join(contexts.select("query_id", F.lower("context").alias("_c")), "query_id")
          .groupBy("query_id").agg(F.round(F.avg(hit.cast("double")) + 1e-9, 6).alias("coverage")))
    return df.withColumn("assessment", F.when(F.col("coverage") >= 0.6, "GOOD").when(F.col("coverage") >= 0.4, "PARTIAL").otherwise("POOR"))


def ranking_metrics(coverage: DataFrame, queries: DataFrame) -> DataFrame:
    asked = queries.agg(F.count(F.lit(1))).scalar()
    good = F.col("assessment") == "GOOD"
    return coverage.agg(
        F.round(F.count(F.lit(1)) / asked + 1e-9, 6).alias("success_rate"), F.round(F.avg("coverage") + 1e-9, 6).alias("avg_coverage"),
        F.round(F.stddev_pop("coverage") + 1e-9, 6).alias("coverage_std"), F.round(F.avg(good.cast("double")) + 1e-9, 6).alias("good_rate"),
        F.round(F.avg((good | (F.col("assessment") == "PARTIAL")).cast("double")) + 1e-9, 6).alias("partial_or_better"))


def expected_content_found(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query the different expected phrases in the hits: GOOD from two on, PARTIAL with one."""
    df = hits_with_expected(hits, expected).groupBy("query_id", "phrase").agg(F.max("found").alias("f"))
    out = df.groupBy("query_id").agg(F.count_if("f").alias("found"), F.array_join(F.array_sort(
        F.collect_list(F.when(F.col("f"), F.col("phrase")))), ",").alias("phrases"))
    return out.withColumn("assessment", F.when(F.col("found") >= 2, "GOOD_RELEVANCE").when(
        F.col("found") == 1, "PARTIAL_RELEVANCE").otherwise("POOR_RELEVANCE"))


def success_rates(found: DataFrame, queries: DataFrame) -> DataFrame:
    asked = queries.agg(F.count(F.lit(1))).scalar()
    rate = F.count_if(F.col("found") >= 2) / asked
    df = found.agg(F.round(rate + 1e-9, 6).alias("success_rate"), F.round(F.count_if(F.col("found") >= 1) / asked + 1e-9, 6).alias("found_rate"))
    r = F.col("success_rate")
    return df.select("*", F.when(r >= 0.8, "EXCELLENT").when(r >= 0.6, "GOOD").when(r >= 0.4, "PARTIAL").otherwise("POOR")
                     .alias("band"), (r >= 0.75).alias("handles_natural_language"))


def gap_analysis(expected_chunks: DataFrame, hits: DataFrame, contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: expected chunks that were not retrieved, coverage in percent, phrases not in the context."""
    key = ["query_id", "chunk_id"]
    got = hits.select(*key).withColumn("_got", F.lit(True))
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_got").isNull(), F.col("chunk_id")))), ",")
    chunks = expected_chunks.select(*key).join(got, key, "left").groupBy("query_id").agg(
        missing.alias("missing_chunks"), F.count_if(F.col("_got").isNull()).alias("n_missing"),
        F.round(100 * F.avg(F.col("_got").isNotNull().cast("double")) + 1e-9, 6).alias("coverage_pct"))
    areas = phrases_in_context(contexts, expected).groupBy("query_id").agg(F.array_join(F.array_sort(
        F.collect_list(F.when(~F.col("found"), F.col("phrase")))), ",").alias("missing_areas"))
    return chunks.join(areas, "query_id", "left")


def user_impact(answer_length: Column, missing: Column) -> list[Column]:
    """Can the task be done, confidence, frustration risk, probability of success."""
    def by(full, minor, major, none) -> Column:
        return (F.when(answer_length <= 100, none).when(missing == 0, full).when(missing <= 1, minor).otherwise(major))
    return [by(True, True, False, False).alias("can_complete"), by(0.9, 0.7, 0.3, 0.0).alias("confidence"),
            by("low", "medium", "high", "high").alias("frustration_risk"), by(0.85, 0.65, 0.25, 0.0).alias("success_probability")]


def answer_indicators(question: Column, answer: Column, tools: list[str], subject: list[str]) -> list[Column]:
    """Completeness, actionability and value as shares of flags, with a band for the value."""
    low, n = F.lower(answer), F.length(answer)
    line_ends = n - F.length(F.replace(answer, F.lit("\n"), F.lit("")))

    def share(*flags: Column) -> Column:
        total = F.lit(0)
        for f in flags:
            total = total + f.cast("int")
        return total / len(flags)

    def has(words: list[str]) -> Column:
        return T.contains_any(low, words)

    complete = share(has(V.STEP_WORDS), has(tools), has(V.ACTION_WORDS), n > 300, has(V.CONTACT_WORDS))
    action = share(F.contains(answer, F.lit(":")) & T.contains_any(answer, [".", ";"]), has(V.PROCEDURE_WORDS),
                   has(V.TOOL_VERBS), (line_ends > 2) | T.contains_any(answer, ["1.", "2.", "3."]), has(V.OUTCOME_WORDS))
    value = F.when(n < 50, 0.0).otherwise(share(
        T.word_overlap(question, answer) > 0.3, n > 200, ~has(V.UNSURE_WORDS), has(subject)))
    band = (F.when(n < 50, "none").when(value >= 0.8, "high").when(value >= 0.6, "moderate").when(value >= 0.4, "low").otherwise("minimal"))
    return [F.when(answer == "", 0.0).otherwise(complete).alias("completeness"),
            F.when(answer == "", 0.0).otherwise(action).alias("actionability"), value.alias("value"), band.alias("value_band")]


SWEEP_THRESHOLDS = [0.30, 0.35, 0.40, 0.42, 0.45, 0.48, 0.50, 0.55, 0.60]
SWEEP_TOP_K = [10, 15, 20, 25, 30, 40, 50]


def parameter_sweep(queries: DataFrame, hits: DataFrame, expected_chunks: DataFrame,
                    thresholds: list[float] = SWEEP_THRESHOLDS, top_ks: list[int] = SWEEP_TOP_K) -> DataFrame:
    """(threshold, top_k): mean success = .4 coverage + .3 done + .2 probability + .1 confidence.

    Hits are retrieved once at the greatest depth. Only the expected chunks among them and the best hit
    meet the grid, so the rows stay queries x grid.
    """
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("top_k")) for t in thresholds for k in top_ks])
    key = ["query_id", "chunk_id"]
    wanted = expected_chunks.select(*key, F.lit(1).alias("_e"))
    n = expected_chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    use = (hits.join(wanted, key, "left").filter("_e = 1 or rank = 1")
           .withColumn("g", F.explode(F.filter(grid, lambda g: (g["top_k"] >= F.col("rank")) & (F.col("score") >= g["threshold"])))))
    got = use.groupBy("query_id", "g").agg(F.sum(F.coalesce("_e", F.lit(0))).alias("covered"),
                                           F.max(F.when(F.col("rank") == 1, F.length("text"))).alias("answer_length"))
    rows = queries.select("query_id", F.explode(grid).alias("g")).join(got, ["query_id", "g"], "left").join(n, "query_id", "left")
    covered, wanted_n = F.coalesce("covered", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    rows = rows.select("g.*", T.ratio(covered, wanted_n).alias("coverage"),
                       *user_impact(F.coalesce("answer_length", F.lit(0)), wanted_n - covered))
    success = (0.4 * F.col("coverage") + 0.3 * F.col("can_complete").cast("double")
               + 0.2 * F.col("success_probability") + 0.1 * F.col("confidence"))
    return rows.groupBy("threshold", "top_k").agg(
        F.round(F.avg(success) + 1e-9, 6).alias("success"), F.round(100 * F.avg("coverage") + 1e-9, 6).alias("coverage_pct"),
        F.round(F.avg(F.col("can_complete").cast("double")) + 1e-9, 6).alias("completion_rate"),
        F.count_if(F.col("coverage") >= 1).alias("fully_covered"))


def section_coverage(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: sections whose phrases are found at 70 % or more, their share, and whether it is 90 %."""
    per = phrases_in_context(contexts, expected).groupBy("query_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("found").alias("f"))
    return per.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(F.col("f") >= 0.7 * F.col("n")).alias("covered"),
        F.sum("f").alias("phrases_found")).select(
        "*", F.round(100 * F.col("covered") / F.col("sections") + 1e-9, 6).alias("coverage_pct"),
        (F.col("covered") >= 0.9 * F.col("sections")).alias("meets_target"))


def answer_gate(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: .6 content + .4 criteria; ready from .7 with content from .5 and under 10 seconds.

    The criteria count as met by an answer of some length with some expected content.
    """
    df = answers.join(expected, "query_id").groupBy("query_id", "answer", "latency").agg(
        F.round(F.avg(F.contains(F.lower("answer"), F.lower("phrase")).cast("double")) + 1e-9, 6).alias("content"))
    criteria = ((F.length("answer") > 50) & (F.col("content") > 0) & (T.word_count(F.col("answer")) > 10)).cast("double")
    score = F.round(F.when(T.strip(F.col("answer")) == "", 0.0).otherwise(0.6 * F.col("content") + 0.4 * criteria) + 1e-9, 6)
    df = df.select("query_id", "content", "latency", score.alias("score"))
    return df.withColumn("ready", (F.col("score") >= 0.7) & (F.col("content") >= 0.5) & (F.col("latency") < 10))


def release_gate(gate: DataFrame, critical: Column) -> DataFrame:
    """One row: rates over all and critical queries, and whether a release may go out."""
    c = critical
    out = gate.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("score") + 1e-9, 6).alias("avg_score"),
        F.round(F.avg("latency") + 1e-9, 6).alias("avg_latency"), F.round(F.avg(F.col("ready").cast("double")) + 1e-9, 6).alias("ready_rate"),
        F.round(F.coalesce(F.avg(F.when(c, F.col("ready").cast("double"))), F.lit(1.0)) + 1e-9, 6).alias("critical_ready_rate"))
    return out.withColumn("release", (F.col("critical_ready_rate") >= 0.8) & (F.col("ready_rate") >= 0.67)
                          & (F.col("avg_latency") < 8) & (F.col("avg_score") >= 0.6))
