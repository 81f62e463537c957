"""Grouping of the hits of a query: runs, semantic groups, topics, sections.

All groups are inside one query, whose hits are bounded by the fetch depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scores as S, text as T
from .dedup import per_query


def group_consecutive(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, first_index, last_index, size): runs of adjacent chunks of a document."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    run = F.col("chunk_index") - F.row_number().over(w)
    return (hits.withColumn("_run", run).groupBy("query_id", "doc_id", "_run")
            .agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"),
                 F.count(F.lit(1)).alias("size")).drop("_run"))


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels from merging the two closest groups (mean distance) while they are below ``cut``."""
    d = distance.astype("float64").copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d))
    label = np.arange(len(d))
    while len(d) and d.min() < cut:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, :], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


def group_semantic(hits: DataFrame, vectors: DataFrame, cut: float = 0.25) -> DataFrame:
    """(query_id, chunk_id, group_id): average linkage on cosine distance, groups by mean score.

    Fewer than three hits are one group. Vectors are fetched for the hits only.
    """
    near = vectors.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    df = hits.select("query_id", "chunk_id", "score", "rank").join(near, "chunk_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        if len(pdf) < 3:
            label = np.zeros(len(pdf), dtype=int)
        else:
            m = np.stack(pdf["embedding"].to_numpy())
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n == 0, 1, n)
            label = average_linkage(np.round(1 - m @ m.T, 9), cut)
        pdf = pdf.assign(label=label)
        order = pdf.groupby("label").agg(mean=("score", "mean"), first=("rank", "min"))
        order = order.sort_values(["mean", "first"], ascending=[False, True])
        place = {old: new for new, old in enumerate(order.index)}
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"],
                             "group_id": pdf["label"].map(place).astype("int32")})

    kind = hits.schema["query_id"].dataType.simpleString()
    return per_query(df, run, f"query_id {kind}, chunk_id string, group_id int")


def topic_weights(hits: DataFrame, min_df: int = 2, max_df: float = 0.85, features: int = 1000) -> DataFrame:
    """(query_id, chunk_id, term, weight): unit TF-IDF rows fitted on the hits of each query."""
    key = ["query_id", "chunk_id"]
    size = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    tf = (hits.join(size, "query_id").select(*key, "n", F.explode(T.terms(F.col("text"))).alias("term"))
          .groupBy(*key, "n", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = (tf.groupBy("query_id", "term", "n").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
          .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))))
    vocabulary = S.top_k(df, features, score="total", tie="term").select("query_id", "term", "df")
    raw = tf.join(vocabulary, ["query_id", "term"]).withColumn(
        "raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*key)))
    return raw.select(*key, "term", (F.col("raw") / norm).alias("weight"))


def topic_similarities(weights: DataFrame) -> DataFrame:
    """(query_id, a, b, similarity), a < b, of hits that share a term."""
    left = weights.select("query_id", "term", F.col("chunk_id").alias("a"), F.col("weight").alias("wa"))
    right = weights.select("query_id", "term", F.col("chunk_id").alias("b"), F.col("weight").alias("wb"))
    return (left.join(right, ["query_id", "term"]).filter("a < b").groupBy("query_id", "a", "b")
            .agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity")))


def topic_edges(similarities: DataFrame, eps: float = 0.3) -> DataFrame:
    return similarities.filter(F.col("similarity") >= round(1 - eps, 6))


def cluster_topics(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, cluster_id): density clusters with a minimum of two members.

    With that minimum the clusters are the connected parts of the edge graph, and hits without an
    edge are noise (null). Clusters are numbered by size, then smallest chunk. Queries with fewer than
    five hits are left out.
    """
    # One row per hit with the list of its neighbours, so rows stay bounded by the fetch depth.
    both = edges.select("query_id", "a", "b").unionByName(edges.select("query_id", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("query_id", F.col("a").alias("chunk_id")).agg(F.collect_list("b").alias("near"))
    df = hits.select("query_id", "chunk_id").join(near, ["query_id", "chunk_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 5:
            return pdf.iloc[:0][["query_id", "chunk_id"]].assign(cluster_id=pd.Series(dtype="Int32"))
        near_of = {c: list(n) if n is not None else [] for c, n in zip(pdf["chunk_id"], pdf["near"])}
        cluster_of: dict[str, int] = {}
        found: list[list[str]] = []
        for start in sorted(near_of):
            if start in cluster_of or not near_of[start]:
                continue
            members, todo = [], [start]
            cluster_of[start] = len(found)
            while todo:
                c = todo.pop()
                members.append(c)
                for other in near_of[c]:
                    if other not in cluster_of:
                        cluster_of[other] = len(found)
                        todo.append(other)
            found.append(members)
        order = sorted(range(len(found)), key=lambda i: (-len(found[i]), min(found[i])))
        place = {old: new for new, old in enumerate(order)}
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"],
                             "cluster_id": pd.array([place.get(cluster_of.get(c)) for c in pdf["chunk_id"]], "Int32")})

    kind = hits.schema["query_id"].dataType.simpleString()
    return per_query(df, run, f"query_id {kind}, chunk_id string, cluster_id int")


def assign_noise(clusters: DataFrame, similarities: DataFrame) -> DataFrame:
    """Every noise hit joins the cluster it is most similar to on average; queries without a cluster
    are left out."""
    members = clusters.filter("cluster_id is not null")
    noise = clusters.filter("cluster_id is null").select("query_id", "chunk_id")
    sizes = members.groupBy("query_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    near = (similarities.select("query_id", F.col("a").alias("chunk_id"), F.col("b").alias("other"), "similarity")
            .unionByName(similarities.select("query_id", F.col("b").alias("chunk_id"), F.col("a").alias("other"), "similarity")))
    sums = (noise.join(near, ["query_id", "chunk_id"])
            .join(members.withColumnRenamed("chunk_id", "other"), ["query_id", "other"])
            .groupBy("query_id", "chunk_id", "cluster_id").agg(F.sum("similarity").alias("s")))
    means = (noise.join(sizes, "query_id").join(sums, ["query_id", "chunk_id", "cluster_id"], "left")
             .withColumn("score", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n"), 6)))
    best = S.top_k(means, 1, by=["query_id", "chunk_id"], tie="cluster_id")
    return (members.withColumn("assigned", F.lit(False))
            .unionByName(best.select("query_id", "chunk_id", "cluster_id", F.lit(True).alias("assigned"))))


def topic_terms(clusters: DataFrame, weights: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, cluster_id, terms): the heaviest terms of each cluster by summed corpus TF-IDF."""
    near = weights.join(clusters.select("chunk_id").distinct(), "chunk_id", "left_semi")
    sums = (clusters.join(near, "chunk_id").groupBy("query_id", "cluster_id", "term")
            .agg(F.round(F.sum("weight"), 6).alias("score")))
    best = S.top_k(sums, most, by=["query_id", "cluster_id"], tie="term")
    return best.groupBy("query_id", "cluster_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))


def cluster_texts(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, cluster_id, text, heading): texts of a cluster in rank order."""
    df = clusters.select("query_id", "chunk_id", "cluster_id").join(
        hits.select("query_id", "chunk_id", "rank", "text"), ["query_id", "chunk_id"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return df.groupBy("query_id", "cluster_id").agg(parts.alias("p")).select(
        "query_id", "cluster_id", F.array_join("p", " ").alias("text"),
        T.extract_heading(F.col("p")[0]).alias("heading"))


def cross_references(texts: DataFrame) -> DataFrame:
    """(query_id, cluster_id, other_id, shared): at least two key terms of a cluster occur in another."""
    key = texts.select("query_id", "cluster_id", F.posexplode(T.extract_key_terms(F.col("text"))).alias("pos", "term"))
    other = texts.select("query_id", F.col("cluster_id").alias("other_id"), F.lower("text").alias("other_text"))
    return (key.join(other, "query_id")
            .filter((F.col("cluster_id") != F.col("other_id")) & F.contains("other_text", F.lower("term")))
            .groupBy("query_id", "cluster_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))
            .filter("shared >= 2"))


def enrich_context(clusters: DataFrame, hits: DataFrame, texts: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, context, sections, cross_references): contents, a section per cluster, related sections.

    ``hits`` has doc_id, chunk_index, text. Inside a section the chunks are in document order; adjacent
    ones are one paragraph.
    """
    doc_order = ["doc_id", "chunk_index"]
    w = Window.partitionBy("query_id", "cluster_id", "doc_id").orderBy("chunk_index")
    df = clusters.select("query_id", "chunk_id", "cluster_id").join(
        hits.select("query_id", "chunk_id", *doc_order, "text"), ["query_id", "chunk_id"])
    runs = (df.withColumn("_run", F.col("chunk_index") - F.row_number().over(w))
            .groupBy("query_id", "cluster_id", "doc_id", "_run")
            .agg(F.min("chunk_index").alias("first"), F.array_join(F.transform(F.array_sort(
                F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ").alias("run_text")))
    clean = T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace("run_text", r"\s+", " "),
                    r"([\p{L}\p{N}_])-\s*([\p{L}\p{N}_])", "$1$2"), r"(?is)Table of Contents.*", ""))
    bodies = runs.withColumn("clean", clean).groupBy("query_id", "cluster_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_id", "first", "clean"))), lambda x: x["clean"]), "\n\n").alias("body"))
    related = references.groupBy("query_id", "cluster_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("other_id")), lambda i: F.concat(F.lit("Section "), (i + 1).cast("string"))), ", ")
        .alias("related"))
    number = (F.col("cluster_id") + 1).cast("string")
    sections = (bodies.join(texts.select("query_id", "cluster_id", "heading"), ["query_id", "cluster_id"])
                .join(related, ["query_id", "cluster_id"], "left")
                .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))))
    title = F.when(F.col("_n") == 1, F.concat(F.lit("INFORMATION: "), F.upper("heading"))).otherwise(
        F.concat(F.lit("SECTION "), number, F.lit(": "), F.upper("heading")))
    section = F.concat(title, F.lit("\n\n"), "body", F.coalesce(
        F.concat(F.lit("\n\nRELATED INFORMATION:\n"), "related"), F.lit("")))
    rows = sections.select("query_id", "cluster_id", "_n", section.alias("section"), F.col("related").isNotNull().alias("r"),
                           F.concat(F.lit("Section "), number, F.lit(": "), "heading", F.lit("\n")).alias("line"))
    packed = F.array_sort(F.collect_list(F.struct("cluster_id", "section", "line")))
    out = rows.groupBy("query_id", "_n").agg(packed.alias("p"), F.count_if("r").alias("cross_references"))
    body = F.array_join(F.transform("p", lambda x: x["section"]), "\n\n---\n\n")
    contents = F.array_join(F.transform("p", lambda x: x["line"]), "")
    return out.select(
        "query_id", F.when(F.col("_n") == 1, body).otherwise(F.concat(
            F.lit("TABLE OF CONTENTS:\n"), contents, F.lit("\n\n\n\n"), body, F.lit("\n\n"))).alias("context"),
        F.col("_n").alias("sections"), "cross_references")
