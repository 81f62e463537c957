"""Approximate nearest neighbours with a forest of hash-prefix trees.

Every tree gives a vector a long string of random hyperplane signs. A tree is the array of these strings in
sorted order, so the vectors that share a prefix with a query are one range of it. A query first descends every tree:
for each prefix length it counts the vectors in its range. Then it ascends all trees together: the
longest prefix length is taken at which the ranges of all trees hold ``share`` of the collection, and all vectors in
these ranges are compared by the exact inner product. Queries whose ranges of ``BASE`` bits hold too few ascend
further, to the root if need be, where they meet all vectors; so no query finds fewer than there are, up to k.

Scale: the sorted arrays are cut at the first ``BASE`` bits and again into blocks of at most ``BLOCK`` strings (by a hash of
the key), so no task holds a tree or a hot prefix; a query visits the blocks of its own prefix only (above
``BASE`` bits those of all prefixes in its range, at the root those of one tree). Counts and
best candidates per block are small rows. Equal vectors are one candidate that stands for its smallest ids
(no more than are asked for can be wanted), and equal queries are asked once.

Inner products of vectors of unequal length are searched by the angle after the usual extra coordinate that
makes all candidates equally long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut_lineage

from . import common

TREES = 16
BITS = 24
BASE = 3
BLOCK = 8192
#: Ranges of all trees together hold this share of the collection (a vector in two trees counts twice).
SHARE = 0.9
SEED = 20


def usable(vec: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED + dims).normal(size=(dims + 1, TREES * BITS)).astype(np.float32)


def _strings(vectors: np.ndarray, extra: np.ndarray, dims: int) -> np.ndarray:
    """Hash strings as integers, vectors x trees; ``extra`` is the added coordinate."""
    h = _planes(dims)
    bits = (vectors.astype(np.float32) @ h[:-1] + extra[:, None].astype(np.float32) * h[-1] > 0).reshape(len(vectors), TREES, BITS)
    return (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(2)


def hashed(reps: DataFrame, most: float, asked: bool) -> DataFrame:
    """vkey, least, vec, tree, code: one row per tree. ``most`` is the largest length; queries get no extra coordinate."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            for dims in sorted({len(v) for v in lists}):
                at = np.array([i for i, v in enumerate(lists) if len(v) == dims])
                for s in range(0, len(at), 2048):
                    own = at[s:s + 2048]
                    x = np.array([lists[i] for i in own], np.float64)
                    size = np.linalg.norm(x, axis=1)
                    scaled = x / (size[:, None] if asked else most)
                    extra = np.zeros(len(own)) if asked else np.sqrt(np.maximum(0, 1 - (size / most) ** 2))
                    codes = _strings(scaled, extra, dims)
                    take = pa.array(own)
                    keys, least = batch.column(0).take(take).to_pylist(), batch.column(2).take(take)
                    vec = pa.array(list(x), pa.list_(pa.float64()))
                    for t in range(TREES):
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), least, vec, pa.array([dims * TREES + t] * len(own), pa.int32()),
                                                          pa.array(codes[:, t], pa.int64())], names=["vkey", "least", "vec", "tree", "code"])
    return reps.select("vkey", "vec", "least").mapInArrow(run, "vkey string, least long, vec array<double>, tree int, code long")


def _dealt(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors with their tree, prefix and block; and of every tree and prefix the number of vectors and blocks."""
    entries = entries.select("*", F.shiftright("code", BITS - BASE).alias("prefix"))
    sizes = entries.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"))
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")))   # at most trees x 2^BASE rows for each number of dimensions
    own = entries.join(sizes, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("vkey"), F.col("blocks")).cast("int")).drop("blocks", "size")
    return own, sizes


def _visits(queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row of each query for every block of its prefixes (array ``prefixes``)."""
    asked = queries.withColumn("prefix", F.explode("prefixes")).drop("prefixes").join(sizes.drop("size"), ["tree", "prefix"])
    return asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _prefixes(level: Column) -> Column:
    """The prefixes of BASE bits in the range of a query's first ``level`` bits."""
    own = F.shiftright("code", BITS - BASE)
    width = F.when(level >= BASE, F.lit(1)).otherwise(F.pow(F.lit(2), F.lit(BASE) - level)).cast("long")
    return F.sequence(own - own % width, own - own % width + width - 1)


def _ranges(sorted_codes: np.ndarray, codes: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the strings that share the first ``level`` bits."""
    rest = BITS - level
    low = codes >> rest << rest
    return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, low + (np.int64(1) << rest))


def descend(own: DataFrame, asked: DataFrame) -> DataFrame:
    """vkey of each query and the number of vectors in its ranges, summed over trees, for every prefix length (columns l3 ... l24)."""
    levels = [f"l{l}" for l in range(BASE, BITS + 1)]
    both = own.select("tree", "prefix", "block", F.lit(None).cast("string").alias("vkey"), "code").unionByName(asked.select("tree", "prefix", "block", "vkey", "code"))

    def run(key, table):
        codes = np.asarray(table.column("code"))
        query = ~np.asarray(table.column("vkey").is_null())
        tree, mine = np.sort(codes[~query]), codes[query]
        out = {"vkey": table.column("vkey").filter(pa.array(query))}
        for l in range(BASE, BITS + 1):
            lo, hi = _ranges(tree, mine, l)
            out[f"l{l}"] = pa.array(hi - lo, pa.int64())
        return pa.table(out)

    counted = both.groupBy("tree", "prefix", "block").applyInArrow(run, "vkey string, " + ", ".join(f"{l} long" for l in levels))
    return counted.groupBy("vkey").agg(*[F.sum(l).alias(l) for l in levels])


def ascend(counts: DataFrame, queries: DataFrame, sizes: DataFrame, wanted: int) -> DataFrame:
    """vkey, level of every query: the longest prefix length whose ranges hold ``wanted`` vectors over all trees, else 0.

    Below ``BASE`` bits the ranges are whole prefixes, so their sizes are enough to count.
    """
    level = F.lit(None).cast("int")
    for l in range(BASE, BITS + 1):
        level = F.when(F.col(f"l{l}") >= wanted, F.lit(l)).otherwise(level)
    deep = cut_lineage(counts.select("vkey", level.alias("level")).where("level is not null"))
    # a query without any vector under its prefixes has no counts
    rest = queries.join(deep, "vkey", "left_anti")
    tops = F.explode(F.array(*[F.struct(F.lit(l).alias("l"), F.shiftright("prefix", BASE - l).alias("top")) for l in range(1, BASE)]))
    held = sizes.select("tree", "size", tops.alias("t")).groupBy("tree", "t.l", "t.top").agg(F.sum("size").alias("size"))
    asked = rest.select("vkey", "tree", F.shiftright("code", BITS - BASE).alias("prefix")).select("vkey", "tree", tops.alias("t")).select("vkey", "tree", "t.*")
    enough = asked.join(held, ["tree", "l", "top"]).groupBy("vkey", "l").agg(F.sum("size").alias("size")).where(F.col("size") >= wanted)
    short = rest.select("vkey").distinct().join(enough.groupBy("vkey").agg(F.max("l").alias("level")), "vkey", "left")
    return deep.unionByName(short.select("vkey", F.coalesce("level", F.lit(0)).alias("level")))


def candidates(own: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, vkey, least, score: for every block the k best of the vectors in a query's range (asked: with level and vec).

    Among equal scores the vectors of smallest ids (``least``) stay.
    """
    none = F.lit(None).cast("int")
    both = (own.select("tree", "prefix", "block", "vkey", "least", "vec", "code", none.alias("level"))
            .unionByName(asked.select("tree", "prefix", "block", "vkey", "least", "vec", "code", "level")))

    def run(key, table):
        table = table.combine_chunks()
        query = ~np.asarray(table.column("level").is_null())
        dims = key[0].as_py() // TREES
        names, ids = np.array(table.column("vkey").to_pylist(), object), np.asarray(table.column("least"))
        codes = np.asarray(table.column("code"))
        x = np.asarray(pa.concat_arrays(table.column("vec").chunks).flatten(), np.float64).reshape(-1, dims) if table.num_rows else np.zeros((0, dims))
        order = np.argsort(codes[~query], kind="stable")
        tree, vec, whose, least = codes[~query][order], x[~query][order], names[~query][order], ids[~query][order]
        mine, q, level, who = codes[query], x[query], np.asarray(table.column("level").filter(pa.array(query))).astype(np.int64), names[query]
        lo, hi = _ranges(tree, mine, level)
        out_q, out_v, out_l, out_s = [], [], [], []
        at = np.lexsort((hi, lo))
        edges = np.flatnonzero(np.diff(lo[at]) | np.diff(hi[at])) + 1
        for same in np.split(at, edges) if len(at) else []:
            a, b = int(lo[same[0]]), int(hi[same[0]])
            if a == b:
                continue
            for s in range(0, len(same), 128):
                part = same[s:s + 128]
                near = q[part] @ vec[a:b].T
                worst = np.partition(near, max(0, b - a - k), axis=1)[:, max(0, b - a - k)]
                # the product's rounding may differ from the final measure by this much
                slack = 1e-12 * dims * np.abs(q[part]).max(1) * np.abs(vec[a:b]).max()
                for i, row, edge in zip(part, near, worst - slack):
                    best = np.flatnonzero(row >= edge)
                    # the final measure sums products in one order, wherever the vector stands
                    score = (vec[a + best] * q[i]).sum(1)
                    keep = np.lexsort((least[a + best], -score))[:k]
                    out_q += [who[i]] * len(keep)
                    out_v += whose[a + best[keep]].tolist()
                    out_l.append(least[a + best[keep]])
                    out_s.append(score[keep])
        scores = np.concatenate(out_s) if out_s else np.zeros(0)
        lows = np.concatenate(out_l) if out_l else np.zeros(0, np.int64)
        return pa.table({"query": pa.array(out_q, pa.string()), "vkey": pa.array(out_v, pa.string()), "least": pa.array(lows, pa.int64()), "score": pa.array(scores, pa.float64())})

    return both.groupBy("tree", "prefix", "block").applyInArrow(run, "query string, vkey string, least long, score double")


def search(vectors: DataFrame, asks: Column, k: int = 20, share: float = SHARE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``asks`` holds, its own id apart.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
    Vectors of different dimensions never meet. Ties go to the smaller id. Repeated ids are one candidate each.
    """
    rows = vectors.where(asks.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("raw"), asks.alias("asks")).where(usable(F.col("raw")))
    rows = rows.select("vec_id", "asks", F.col("raw").cast("array<double>").alias("vec")).withColumn("vkey", F.md5(F.concat_ws(",", F.col("vec").cast("array<string>"))))
    rows = cut_lineage(rows)
    # of equal vectors the k + 1 smallest ids can be wanted (one may be the query itself)
    ids = rows.select("vkey", "vec_id").distinct()
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    reps = cut_lineage(rows.groupBy("vkey").agg(F.first("vec").alias("vec"), F.max(F.col("asks").cast("int")).alias("asks"), F.min("vec_id").alias("least")))
    n, most = reps.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    own, sizes = _dealt(hashed(reps, most, False))
    own, queries = cut_lineage(own), cut_lineage(hashed(reps.where("asks = 1"), most, True))
    # a vector counts once per tree, so this many are at least k + 1 different ones
    wanted = max(TREES * (k + 1), int(share * n))
    level = ascend(descend(own, _visits(queries.withColumn("prefixes", _prefixes(F.lit(BASE))), sizes)), queries, sizes, wanted)
    # at the root every tree holds the same vectors
    levelled = queries.join(level, "vkey").where((F.col("level") > 0) | (F.col("tree") % TREES == 0))
    found = candidates(own, _visits(levelled.withColumn("prefixes", _prefixes(F.col("level"))), sizes), k + 1).groupBy("query", "vkey", "least").agg(F.max("score").alias("score"))
    # k + 1 different vectors are enough, of equal scores those with the smallest ids
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n", "least")
    pairs = found.join(ids, "vkey").select(F.col("query").alias("vkey"), "vec_id", "score")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vkey").distinct()
    out = queries.join(pairs, "vkey").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_prefix_forest(spark, folder: str) -> DataFrame:
    return search(common.table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
