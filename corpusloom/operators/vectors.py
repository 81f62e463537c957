"""Dense vector operators: exact and cell-based nearest neighbours, similarity joins, profiles.

Scores are cosine similarities rounded to six digits; larger is better; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scores as S
from ..session import cut_lineage, has_at_most, scratch_folder, write_step

# Queries up to this number are sent to every task (64 MB at 1,024 dimensions of 8 bytes).
BROADCAST_QUERIES = 8192
# Rows of one side in one task of a block join.
BLOCK_ROWS = 20_000
# Scores that a task holds at once (64 MB).
TILE = 8_000_000
# Numbers that a round of a block join may copy (512 MB); a round has one band or one block of the left side at least.
ROUND = 1 << 26


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _round(sims: np.ndarray) -> np.ndarray:
    """Six digits; the small shift sends exact halves up whatever the order of summation was."""
    return np.round(sims + 1e-9, 6)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Unit vectors as rows; all must have the same number of dimensions."""
    if isinstance(column, pd.Series):
        return _unit(np.stack(column.to_numpy()).astype("float64")) if len(column) else np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(flat) % max(len(column), 1):
        raise ValueError("vectors differ in their number of dimensions")
    return _unit(flat.reshape(len(column), -1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then id; ties at the border are kept for the id order."""
    if len(scores) > k:
        border = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= border)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _scan_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str) -> DataFrame:
    """One pass over the vectors; each task keeps k hits per query. Queries are bounded."""
    # At most BROADCAST_QUERIES rows: the caller has counted them.
    block = queries.select("query_id", "embedding").toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast((
        block["query_id"].to_numpy(), _matrix(block["embedding"]) if len(block) else np.zeros((0, 0))))
    id_type = vectors.schema[key].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_mat = shared.value
        kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q_ids)
        least = np.full(len(q_ids), -np.inf)  # the k-th best score, once there are k
        step = max(1, TILE // max(1, len(q_ids)))
        for whole in batches:
            for start in range(0, len(whole) if len(q_ids) else 0, step):
                pdf = whole.iloc[start:start + step]
                ids, sims = pdf[key].to_numpy(), _round(q_mat @ _matrix(pdf["embedding"]).T)
                near = sims >= least[:, None]
                for q in np.flatnonzero(near.any(axis=1)):
                    s, i = sims[q][near[q]], ids[near[q]]
                    if kept[q] is not None:
                        s, i = np.concatenate([kept[q][0], s]), np.concatenate([kept[q][1], i])
                    at = _best(s, i, k)
                    kept[q] = (s[at], i[at])
                    if len(at) == k:
                        least[q] = s[at[-1]]
        for at in range(0, len(q_ids), 1000):
            hits = [(q, *kept[q]) for q in range(at, min(at + 1000, len(q_ids))) if kept[q] is not None and len(kept[q][0])]
            if hits:
                yield pd.DataFrame({"query_id": np.repeat(q_ids[[q for q, _, _ in hits]], [len(s) for _, s, _ in hits]),
                                    key: np.concatenate([i for _, _, i in hits]), "score": np.concatenate([s for _, s, _ in hits])})

    found = vectors.select(key, "embedding").mapInPandas(
        run, f"query_id {q_type}, `{key}` {id_type}, score double")
    return S.top_k(found, k, tie=key)


def _grid_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str) -> DataFrame:
    """Exact top-k for any number of queries: blocks of queries meet blocks of vectors."""
    q_blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    v_blocks = max(1, math.ceil(vectors.count() / BLOCK_ROWS))

    def spread(df: DataFrame, own: str, other: str, own_n: int, other_n: int, by: str) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))))

    left = spread(queries.select("query_id", "embedding"), "qb", "vb", q_blocks, v_blocks, "query_id")
    right = spread(vectors.select(key, "embedding"), "vb", "qb", v_blocks, q_blocks, key)
    id_type = vectors.schema[key].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()

    found = (left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb"))
             .applyInPandas(_block_top_k(k, key), f"query_id {q_type}, `{key}` {id_type}, score double"))
    return S.top_k(found, k, tie=key)


def _block_top_k(k: int, key: str):
    """Best rows of one block of vectors for one block of queries, in tiles of ``TILE`` scores."""
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            ids, mat, q_ids, q_mat = v[key].to_numpy(), _matrix(v["embedding"]), q["query_id"].to_numpy(), _matrix(q["embedding"])
            step = max(1, TILE // len(ids))
            for start in range(0, len(q_ids), step):
                for q_id, row in zip(q_ids[start:start + step], _round(q_mat[start:start + step] @ mat.T)):
                    at = _best(row, ids, k)
                    out.append(pd.DataFrame({"query_id": q_id, key: ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []}, dtype=object)
    return run


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """hits(query_id, key, score, rank): the k most similar vectors of every query."""
    if has_at_most(queries, BROADCAST_QUERIES):
        return _scan_top_k(queries, vectors, k, key)
    return _grid_top_k(queries, vectors, k, key)


PROBES = {"low": 10, "medium": 20, "high": 50}
#: Rows per cell that k-means is trained on, drawn by a hash of the key; every row gets a cell.
TRAIN_PER_CELL = 64


def cell_count(rows: int) -> int:
    """About the square root of the rows, with 39 rows a cell at least."""
    return max(4, min(int(math.sqrt(rows)), rows // 39))


class CellStore:
    """Vectors partitioned by cell on storage, and the centroids beside them (one row per cell, about sqrt(rows)).

    ``widths`` = the largest angle between a centroid and a vector of its cell.
    """

    def __init__(self, vectors: DataFrame, centroids: np.ndarray, cells: np.ndarray, key: str, widths: np.ndarray | None = None):
        self.vectors, self.centroids, self.cells, self.key = vectors, centroids, cells, key
        self.widths = np.full(len(cells), math.pi) if widths is None else widths


def write_cells(vectors: DataFrame, path: str, key: str, cells: int | None = None, seed: int = 42) -> None:
    """Train cells, and write ``path/vectors`` (partitioned by cell) and ``path/centroids``.

    Spark ML's k-means runs on ``TRAIN_PER_CELL`` rows per cell. Vectors without length lie in the cell whose centroid is
    first; they score 0 wherever they lie.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut_lineage(vectors.select(key, "embedding"))
    count = rows.count()
    cells = cells or cell_count(count)
    share = cells * TRAIN_PER_CELL / max(count, 1)
    sample = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    features = cut_lineage(sample.select(array_to_vector(S.l2_normalize(F.col("embedding"))).alias("features")))
    model = KMeans(k=cells, seed=seed, maxIter=8, initMode="random", featuresCol="features").fit(features)
    centroids = np.stack(model.clusterCenters())
    shared = rows.sparkSession.sparkContext.broadcast(_unit(centroids))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((_matrix(v) @ shared.value.T).argmax(axis=1).astype("int32"))

    placed = rows.withColumn("cell", nearest("embedding"))
    # a large cell is written by several tasks, a small one by one
    salt = F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(count / cells / BLOCK_ROWS))))
    placed.repartition("cell", salt).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    central = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")

    @F.pandas_udf("double")
    def angle(cell: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_angles(np.einsum("ij,ij->i", _matrix(v), shared.value[cell.to_numpy()]) if len(v) else np.zeros(0)))

    widths = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max(angle("cell", "embedding")).alias("width"))
    central.join(widths, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def open_cells(spark: SparkSession, path: str, key: str) -> CellStore:
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    widths = table["width"].fillna(0.0).to_numpy("float64") if "width" in table else None  # a cell without rows
    return CellStore(spark.read.parquet(f"{path}/vectors"), np.stack(table["centroid"].to_numpy()), table["cell"].to_numpy(), key, widths)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def search_cells(queries: DataFrame, store: CellStore, k: int, nprobe: int, exact: bool = False) -> DataFrame:
    """hits(query_id, key, score, rank) among the ``nprobe`` cells nearest to each query, for any number of queries.

    With ``exact`` the other cells follow, as far as their width and the angle of the query leave room for a vector as near as the
    k-th hit; so the hits are those of an exact search, and how much is read depends on how clustered the vectors are.
    Only the asked cells are read (partition filter). Up to ``BROADCAST_QUERIES`` queries go to the tasks that read
    the cells, where a query meets no vector of another cell and each task keeps its k best; beyond that, blocks
    of queries and vectors of a cell meet in a join.
    """
    centres, cells, key, widths = _unit(store.centroids), store.cells, store.key, store.widths
    probes = min(nprobe, len(centres))

    def near(v: pd.Series) -> np.ndarray:
        return np.argsort(-(_matrix(v) @ centres.T), axis=1, kind="stable")[:, :probes]

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(list(cells[near(v)].astype("int32")) if len(v) else [])

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, least: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([])
        # a vector of the cell is at most its width nearer to the query than the centroid is
        room = np.cos(np.maximum(_angles(_matrix(v) @ centres.T) - widths, 0.0)) >= least.to_numpy("float64")[:, None] - 2e-6
        room[np.arange(len(room))[:, None], near(v)] = False
        return pd.Series([cells[r].astype("int32") for r in room])

    asked = queries.select("query_id", "embedding")
    hits = _search_cells(asked.withColumn("cells", nearest("embedding")), store, k)
    if not exact or probes == len(centres):
        return hits
    hits = cut_lineage(hits)
    least = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    more = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rest = _search_cells(cut_lineage(more.select("query_id", "embedding", others("embedding", "least").alias("cells"))), store, k)
    return S.top_k(hits.drop("rank").unionByName(rest.drop("rank")), k, tie=key)


def _search_cells(probed: DataFrame, store: CellStore, k: int) -> DataFrame:
    """The hits of queries (query_id, embedding, cells) in their cells."""
    key, queries = store.key, probed.select("query_id", "embedding")
    if not has_at_most(queries, BROADCAST_QUERIES):
        return _join_cells(cut_lineage(probed.select("query_id", "embedding", F.explode("cells").alias("cell"))), store.vectors, k, key)
    block = probed.toPandas()
    asked = sorted({int(c) for row in block["cells"] for c in row})
    own = {c: [] for c in asked}
    for i, row in enumerate(block["cells"]):
        for c in row:
            own[int(c)].append(i)
    shared = queries.sparkSession.sparkContext.broadcast((
        block["query_id"].to_numpy(), _matrix(block["embedding"]) if len(block) else np.zeros((0, 0)), {c: np.array(q) for c, q in own.items()}))
    id_type = store.vectors.schema[key].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_mat, by_cell = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, ids = np.asarray(batch.column("cell")), batch.column(key).to_numpy(zero_copy_only=False)
            mat = _matrix(batch.column("embedding"))
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), by_cell[int(c)]
                step = max(1, TILE // len(at))
                for start in range(0, len(who), step):
                    part = who[start:start + step]
                    for q, row in zip(part.tolist(), _round(q_mat[part] @ mat[at].T)):
                        s, i = row, ids[at]
                        if q in kept:
                            s, i = np.concatenate([kept[q][0], s]), np.concatenate([kept[q][1], i])
                        best = _best(s, i, k)
                        kept[q] = (s[best], i[best])
        if kept:
            sizes = [len(s) for s, _ in kept.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[list(kept)], sizes)), pa.array(np.concatenate([i for _, i in kept.values()])),
                                              pa.array(np.concatenate([s for s, _ in kept.values()]))], names=["query_id", key, "score"])

    pruned = store.vectors.where(F.col("cell").isin(asked))
    found = pruned.select("cell", key, "embedding").mapInArrow(run, f"query_id {q_type}, `{key}` {id_type}, score double")
    return S.top_k(found, k, tie=key)


def _join_cells(asked: DataFrame, celled: DataFrame, k: int, key: str) -> DataFrame:
    """Queries meet the vectors of their cells; large cells are cut into blocks of about ``BLOCK_ROWS`` of each side."""
    sizes = (asked.select("cell", F.lit(1).alias("q"), F.lit(0).alias("v"))
             .union(celled.select("cell", F.lit(0).alias("q"), F.lit(1).alias("v")))
             .groupBy("cell").agg(F.ceil(F.sum("q") / BLOCK_ROWS).cast("int").alias("qn"),
                                  F.ceil(F.sum("v") / BLOCK_ROWS).cast("int").alias("vn"))
             .filter("qn > 0 and vn > 0"))  # one row per cell, as the centroids that every task holds

    def spread(df: DataFrame, own: str, own_n: str, other: str, other_n: str, by: str) -> DataFrame:
        return (df.join(F.broadcast(sizes), "cell").withColumn(own, F.pmod(F.xxhash64(by), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .select("cell", "qb", "vb", by, "embedding"))

    grid = ["cell", "qb", "vb"]
    left, right = spread(asked, "qb", "qn", "vb", "vn", "query_id"), spread(celled, "vb", "vn", "qb", "qn", key)
    id_type = celled.schema[key].dataType.simpleString()
    q_type = asked.schema["query_id"].dataType.simpleString()
    found = (left.groupBy(*grid).cogroup(right.groupBy(*grid))
             .applyInPandas(_block_top_k(k, key), f"query_id {q_type}, `{key}` {id_type}, score double"))
    return S.top_k(found, k, tie=key)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id",
            recall: str = "medium", flat_below: int = 0, path: str | None = None) -> DataFrame:
    """Approximate top-k over vectors that have no store yet: writes one (at ``path`` or in the scratch folder) and searches it.

    With ``flat_below`` a collection of fewer vectors is searched exactly.
    """
    rows = vectors.count()
    if rows < max(flat_below, 4):
        return knn_exact(queries, vectors, k, key)
    path = path or scratch_folder(vectors.sparkSession, "cells")
    write_cells(vectors, path, key)
    return search_cells(queries, open_cells(vectors.sparkSession, path, key), k, PROBES[recall])


def pair_similarity(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Cosine and band of listed pairs (a, b)."""
    left = vectors.select(F.col(key).alias("a"), F.col("embedding").alias("_va"))
    right = vectors.select(F.col(key).alias("b"), F.col("embedding").alias("_vb"))
    sim = F.round(S.cosine(F.col("_va"), F.col("_vb")), 6)
    return (pairs.join(left, "a").join(right, "b").select("a", "b", sim.alias("similarity"))
            .withColumn("band", F.when(F.col("similarity") > 0.7, "HIGH")
                        .when(F.col("similarity") > 0.5, "MEDIUM").otherwise("LOW")))


ABOVE = (0.8, 0.5, 0.3)


def _profile_part(queries: DataFrame, vectors: DataFrame, key: str, ends: int) -> DataFrame:
    """Per task and query: scores counted in millionths, and both ends. One pass over the vectors; queries are bounded by the caller."""
    block = queries.select("query_id", "embedding").toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast((block["query_id"].to_numpy(), _matrix(block["embedding"]) if len(block) else np.zeros((0, 0))))
    id_type, q_type = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, scores binary, counts binary, ids array<{id_type}>, end_scores array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_mat = shared.value
        seen: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, "<i4"), np.zeros(0, "<i8"))] * len(q_ids)
        kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q_ids)
        step = max(1, TILE // max(1, len(q_ids)))
        for whole in batches:
            for start in range(0, whole.num_rows if len(q_ids) else 0, step):
                batch = whole.slice(start, step)
                ids, sims = batch.column(key).to_numpy(zero_copy_only=False), _round(q_mat @ _matrix(batch.column("embedding")).T)
                for q, row in enumerate(sims):
                    seen[q] = _merged_counts([seen[q], np.unique(np.rint(row * 1e6).astype("<i4"), return_counts=True)])
                    s, i = (row, ids) if kept[q] is None else (np.concatenate([kept[q][0], row]), np.concatenate([kept[q][1], ids]))
                    at = np.union1d(_best(s, i, ends), _best(-s, i, ends))
                    kept[q] = (s[at], i[at])
        at = [q for q in range(len(q_ids)) if kept[q] is not None]
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[at]), pa.array([seen[q][0].astype("<i4").tobytes() for q in at], pa.binary()), pa.array([seen[q][1].astype("<i8").tobytes() for q in at], pa.binary()),
                 pa.array([kept[q][1] for q in at]), pa.array([kept[q][0] for q in at], pa.list_(pa.float64()))], names=["query_id", "scores", "counts", "ids", "end_scores"])

    return vectors.select(key, "embedding").mapInArrow(run, schema)


def _merged_counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def similarity_profile(queries: DataFrame, vectors: DataFrame, key: str, ends: int = 10) -> DataFrame:
    """Per query over all vectors: counts above .8/.5/.3, min, max, mean, upper median, ids of both ends.

    Every task makes a summary per query that merges exactly: how often each score (in millionths) occurs, and its ``ends`` best and worst
    rows. So no row per query and vector leaves a task, and one pass serves a block of ``BROADCAST_QUERIES`` queries; more queries take
    a pass for each block.
    """
    blocks = max(1, math.ceil(queries.count() / BROADCAST_QUERIES))
    asked = cut_lineage(queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks if blocks > 1 else 1)).alias("_b"))) if blocks > 1 else None
    parts = [_profile_part(asked.where(F.col("_b") == b), vectors, key, ends) for b in range(2 * blocks)] if asked is not None else [_profile_part(queries, vectors, key, ends)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    q_type = queries.schema["query_id"].dataType.simpleString()
    above = ", ".join(f"above_{int(t * 10)} long" for t in ABOVE)

    def merge(table):
        values, counts = _merged_counts([(np.frombuffer(v, "<i4"), np.frombuffer(c, "<i8")) for v, c in zip(table.column("scores").to_pylist(), table.column("counts").to_pylist())])
        ids = np.array([i for x in table.column("ids").to_pylist() for i in x])
        scores = np.array([s for x in table.column("end_scores").to_pylist() for s in x])
        n, upto = int(counts.sum()), np.cumsum(counts)
        shown = lambda x: round(x / 1e6, 6)
        out = {"query_id": table.column("query_id")[0].as_py(), "n": n, "min_score": shown(int(values[0])), "max_score": shown(int(values[-1])),
               "avg_score": round(int((values.astype(np.int64) * counts).sum()) / n / 1e6, 6), "median_upper": shown(int(values[np.searchsorted(upto, n // 2, side="right")])),
               "top_ids": ",".join(str(i) for i in ids[_best(scores, ids, ends)]), "bottom_ids": ",".join(str(i) for i in ids[_best(-scores, ids, ends)])}
        out |= {f"above_{int(t * 10)}": int(counts[values > round(t * 1e6)].sum()) for t in ABOVE}
        return pa.table({k: [v] for k, v in out.items()})

    return found.groupBy("query_id").applyInArrow(merge, f"query_id {q_type}, n long, min_score double, max_score double, avg_score double, median_upper double, "
                                                         f"top_ids string, bottom_ids string, {above}")


def vector_store_check(vectors: DataFrame, expected_rows: int | None = None, key: str = "vec_id") -> DataFrame:
    """One row per violation: (check, detail). No rows means a sound store."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"),
                        F.max(F.size("embedding")).alias("hi"),
                        F.count_if(F.col("embedding").isNull()).alias("missing"))
    checks = [
        (F.col("n") == 0, "empty_store", F.col("n")),
        (F.col("missing") > 0, "missing_vectors", F.col("missing")),
        (F.col("lo") != F.col("hi"), "mixed_dimensions", F.col("hi") - F.col("lo")),
        (F.col("n") < 10, "very_few_chunks", F.col("n")),
        (F.col("n") > 1000, "very_many_chunks", F.col("n")),
    ]
    if expected_rows is not None:
        checks.append((F.col("n") != expected_rows, "count_mismatch", F.col("n")))
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(name).alias("check"), n.cast("long").alias("detail")))
        for test, name, n in checks]))
    return stats.select(F.explode(found).alias("v")).select("v.check", "v.detail")


# --- similarity joins ----------------------------------------------------------------------

def distinct_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """One row per different vector, named by its smallest id; equal rows fold before the shuffle.

    Vectors without length (blank texts) are similar to nothing, so each of them stays a row of its own.
    """
    alone = F.when(is_zero("embedding"), F.col(key))
    return vectors.groupBy("embedding", alone.alias("_alone")).agg(F.min(key).alias(key)).select(key, "embedding")


def is_zero(vector: str) -> Column:
    return ~F.exists(vector, lambda x: x != 0)


@dataclass(frozen=True)
class Keys:
    """Join keys of a similarity join: ``bands`` keys of ``bits`` hyperplane signs each; a row is copied once per band.

    Two vectors at angle x share a sign with probability 1 - x / pi, so a pair at the threshold or above shares at
    least one whole key with a probability of ``recall`` or more. Without bands all rows meet in blocks: exact.
    """

    bits: int
    bands: int
    recall: float


#: Rows that a key should hold on average, and the most copies of a row.
KEY_ROWS = 2_500
MOST_BANDS = 64


def join_keys(rows: int, threshold: float, miss: float = 1e-4, exact: bool = False) -> Keys:
    """The keys for a join of ``rows`` vectors. A pair may be missed with probability ``miss`` at most.

    Rows that fit into one block need no keys. Where the threshold is so low that keys would hardly spare any
    comparison, the join is refused unless ``exact`` asks for all blocks.
    """
    if exact or rows <= BLOCK_ROWS:
        return Keys(0, 0, 1.0)
    same = 1 - math.acos(max(-1.0, min(1.0, threshold - 1e-6))) / math.pi
    wanted = min(30, max(1, math.ceil(math.log2(rows / KEY_ROWS))))
    for bits in sorted(range(1, 31), key=lambda b: abs(b - wanted)):
        bands = math.ceil(math.log(miss) / math.log1p(-same ** bits))
        if bands <= MOST_BANDS and bands < 2 ** bits / 4:
            return Keys(bits, bands, 1 - (1 - same ** bits) ** bands)
    raise ValueError(f"no keys find pairs above {threshold} with recall {1 - miss}; raise miss or threshold, or ask for exact=True (all blocks)")


def with_keys(vectors: DataFrame, keys: Keys, key: str, seed: int = 42) -> DataFrame:
    """(key, embedding, keys): the signs of each band as one number."""
    if not keys.bands:
        return vectors.select(key, "embedding", F.array().cast("array<int>").alias("keys"))

    @F.pandas_udf("array<int>")
    def signs(v: pd.Series) -> pd.Series:
        matrix = _matrix(v)
        planes = np.random.default_rng(seed + matrix.shape[1]).normal(size=(matrix.shape[1], keys.bands * keys.bits))
        bits = (matrix @ planes > 0).reshape(len(matrix), keys.bands, keys.bits)
        return pd.Series(list((bits << np.arange(keys.bits)).sum(axis=2).astype("int32")))

    return vectors.select(key, "embedding", signs("embedding").alias("keys"))


def _block_join(left: DataFrame, right: DataFrame, key: str, keys: Keys, kernel, schema: str, shown: bool = True) -> DataFrame:
    """Run ``kernel(left rows, right rows, band)`` on rows that share a key; inputs are from ``with_keys``, which ``shown`` leaves out.

    A key with many rows is cut into a grid of blocks, so no task gets more than about BLOCK_ROWS rows of a side. Rounds take some bands (without
    keys: some blocks of the left side), so that only the copies for these are on disk at a time; what a round finds is stored.
    """
    columns = [key, "embedding"] + (["keys"] if shown else [])

    def cells(df: DataFrame, first: int, n: int) -> DataFrame:
        if not keys.bands:
            return df.select(F.lit(0).alias("band"), F.lit(0).alias("cell"), *columns)
        return df.select(F.posexplode(F.slice("keys", first + 1, n)).alias("band", "cell"), *columns).withColumn("band", F.col("band") + first)

    every = max(1, keys.bands)
    sizes = (cells(left, 0, every).select("band", "cell", F.lit(1).alias("l"), F.lit(0).alias("r"))
             .union(cells(right, 0, every).select("band", "cell", F.lit(0).alias("l"), F.lit(1).alias("r")))
             .groupBy("band", "cell").agg(F.ceil(F.sum("l") / BLOCK_ROWS).cast("int").alias("ln"),
                                          F.ceil(F.sum("r") / BLOCK_ROWS).cast("int").alias("rn")))
    # only keys with more than a block of rows; the others are one block
    large = cut_lineage(sizes.filter("ln > 1 or rn > 1"))
    parts = every if keys.bands else (large.agg(F.max("ln")).first()[0] or 1)
    large = F.broadcast(large) if has_at_most(large, BLOCK_ROWS) else large
    count = lambda n: F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))

    def joined(first: int, n: int) -> DataFrame:
        def blocks(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
            df = (cells(df, first, n).join(large, ["band", "cell"], "left").withColumn(own, F.pmod(F.xxhash64(key), count(own_n)).cast("int"))
                  .withColumn(other, F.explode(F.sequence(F.lit(0), count(other_n) - 1))).select("band", "cell", "lb", "rb", *columns))
            return df if keys.bands or n >= parts else df.filter(F.col("lb").between(first, first + n - 1))

        grid = ["band", "cell", "lb", "rb"]
        near = blocks(right, "rb", "rn", "lb", "ln")
        near = near.select([F.col(c).alias(f"right_{c}") for c in near.columns])

        def run(at, l_pdf: pd.DataFrame, r_pdf: pd.DataFrame) -> pd.DataFrame:
            return kernel(l_pdf, r_pdf.rename(columns=lambda c: c.removeprefix("right_")), int(at[0]))

        return (blocks(left, "lb", "ln", "rb", "rn").groupBy(*grid)
                .cogroup(near.groupBy(*[f"right_{c}" for c in grid])).applyInPandas(run, schema))

    wide = left.agg(F.max(F.size("embedding"))).first()[0] or 1
    n = max(1, ROUND // max(1, wide * (left.count() + right.count())))
    if n >= parts:
        return joined(0, parts)
    found = [cut_lineage(joined(first, n)) for first in range(0, parts, n)]
    return reduce(DataFrame.unionByName, found)


def _first_met(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """True for pairs of key rows that share no earlier band, so each pair comes from one band only."""
    return ~(left[:, :band] == right[:, :band]).any(axis=1)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", neighbours: int = 10, miss: float = 1e-4,
                  exact: bool = False) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: for each row its most similar later rows, at most
    ``neighbours``. Copies are rows like any other; each block keeps ``neighbours`` rows of a row, so a large
    group of copies costs rows, not pairs. Vectors without length are in no pair. As long as there are no more
    blocks than bands, keys would copy a row as often, so all blocks meet and no pair is missed. See ``join_keys`` for
    ``miss`` and ``exact``; ``join_keys(rows, threshold).bands`` tells how often a row is copied."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = write_step(vectors.filter(~is_zero("embedding")).select(key, "embedding"), scratch_folder(vectors.sparkSession, "pair-vectors"), compression="zstd")
    count = rows.count()
    keys = join_keys(count, threshold, miss, exact)
    if count <= keys.bands * BLOCK_ROWS:
        keys = join_keys(count, threshold, miss, exact=True)
    keyed = with_keys(rows, keys, key)
    if keys.bands:  # every round reads them
        keyed = write_step(keyed, scratch_folder(vectors.sparkSession, "pair-keys"), compression="zstd")

    def kernel(left: pd.DataFrame, right: pd.DataFrame, band: int) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            l_ids, r_ids, r_mat = left[key].to_numpy(), right[key].to_numpy(), _matrix(right["embedding"])
            l_keys, r_keys = (np.stack(x["keys"].to_numpy()) for x in (left, right))
            step = max(1, TILE // 4 // len(right))
            for at in range(0, len(left), step):
                sims = _matrix(left["embedding"].iloc[at:at + step]) @ r_mat.T
                for a, own, row in zip(l_ids[at:at + step], l_keys[at:at + step], sims):
                    later = np.flatnonzero((row > threshold - 1e-6) & (r_ids > a))
                    row[later] = _round(row[later])  # only what may be above the threshold is rounded
                    later = later[row[later] > threshold]
                    if band and len(later):
                        later = later[_first_met(own[None, :], r_keys[later], band)]
                    if len(later):
                        best = later[_best(row[later], r_ids[later], neighbours)]
                        out.append(pd.DataFrame({"id_a": a, "id_b": r_ids[best], "similarity": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"id_a": [], "id_b": [], "similarity": []}, dtype=object)

    pairs = _block_join(keyed, keyed, key, keys, kernel, f"id_a {kind}, id_b {kind}, similarity double")
    return S.top_k(pairs, neighbours, by="id_a", score="similarity", tie="id_b").select("id_a", "id_b", "similarity")


def first_similar(left: DataFrame, right: DataFrame, threshold: float, key: str, keys: Keys) -> DataFrame:
    """(key, by): for each right row with a similar smaller left row, the smallest such row.

    Both sides are from ``with_keys``. Each block gives at most one row per right row, so a large group of
    alike rows costs rows, not pairs."""
    kind = right.schema[key].dataType.simpleString()

    def kernel(l_pdf: pd.DataFrame, r_pdf: pd.DataFrame, band: int) -> pd.DataFrame:
        if not len(l_pdf) or not len(r_pdf):
            return pd.DataFrame({key: [], "by": []}, dtype=object)
        l_ids, r_ids = l_pdf[key].to_numpy(), r_pdf[key].to_numpy()
        order = np.argsort(l_ids, kind="stable")
        l_ids, l_mat, r_mat = l_ids[order], _matrix(l_pdf["embedding"])[order], _matrix(r_pdf["embedding"])
        smaller, first = np.searchsorted(l_ids, r_ids), np.full(len(r_ids), -1)
        # left rows rise, so the first one found is the smallest; a right row is done with it, or when the left rows pass it
        for at in range(0, len(l_ids), 512):
            todo = np.flatnonzero((first < 0) & (smaller > at))
            sims = l_mat[at:at + 512] @ r_mat[todo].T
            hit = sims > threshold - 1e-6
            hit &= np.arange(at, at + len(hit))[:, None] < smaller[todo]
            hit[hit] = _round(sims[hit]) > threshold
            met = hit.any(axis=0)
            first[todo[met]] = at + hit[:, met].argmax(axis=0)
        got = first >= 0
        return pd.DataFrame({key: r_ids[got], "by": l_ids[first[got]]})

    found = _block_join(left, right, key, keys, kernel, f"`{key}` {kind}, by {kind}", shown=False)
    return found.groupBy(key).agg(F.min("by").alias("by"))
