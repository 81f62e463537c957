"""Language identification with a byte convolutional network.

A text is cut into windows of fixed length. Filters of several widths slide over the bytes of a window,
each keeps its maximum, and a softmax layer over the maxima gives the language. Windows go through the
network in batches; a text's prediction is the mean of its windows' distributions, weighted by their bytes.
The network is trained here, in numpy, on a bounded sample of labelled texts.

For prediction the filters are unrolled to tables over byte pairs: the response of a width-4 filter at a
position is the sum of two table rows, so a batch costs two gathers and one maximum per byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 128
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass(frozen=True)
class Network:
    """Trained weights; small enough to travel inside a task's closure (under 100 KB)."""
    labels: tuple[str, ...]
    embedding: np.ndarray   # 256 x d
    filters: np.ndarray     # 4 d x f, rows of unused offsets are zero
    bias: np.ndarray        # f
    head: np.ndarray        # f x labels
    head_bias: np.ndarray


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lowered()


def windows_of(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over all bytes of all rows: windows x (WINDOW + 3), row of each, bytes in each.

    The three extra places let the widest filter start at the last byte; they hold 0, as does the rest of
    a row's last window.
    """
    sizes = np.diff(limits)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    start = limits[:-1][row] + WINDOW * (np.arange(len(row)) - first[row])
    own = np.minimum(WINDOW, limits[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < own[:, None]
    out = np.zeros((len(row), WINDOW + 3), np.uint8)
    if len(row):
        out[:, :WINDOW] = np.where(inside, LOWER[data[np.minimum(at, len(data) - 1)]], 0)
    return out, row, own


def train(texts: list[str], labels: list[str], dims: int = 8, per_width: int = 16, steps: int = 900,
          batch: int = 64, windows_per_text: int = 4, seed: int = 7) -> Network:
    """Adam on cross entropy over windows drawn evenly from the labels."""
    rng = np.random.default_rng(seed)
    names = tuple(sorted(set(labels)))
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    wins, row, _ = windows_of(data, np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    # a long text gives a few windows only, so that it does not outweigh the others
    order = rng.permutation(len(row))
    order = order[np.argsort(row[order], kind="stable")]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    picked = order[rank < windows_per_text]
    wins, y = wins[picked], np.array([names.index(l) for l in labels])[row[picked]]
    by_label = [np.flatnonzero(y == k) for k in range(len(names))]
    by_label = [b for b in by_label if len(b)]
    f = per_width * len(WIDTHS)
    used = np.zeros((max(WIDTHS), f), np.float32)
    for i, w in enumerate(WIDTHS):
        used[:w, i * per_width:(i + 1) * per_width] = 1
    mask = np.repeat(used, dims, axis=0)
    p = {"e": rng.normal(0, 0.5, (256, dims)), "w": rng.normal(0, 0.2, (4 * dims, f)) * mask, "b": np.zeros(f),
         "h": rng.normal(0, 0.1, (f, len(names))), "c": np.zeros(len(names))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, max(1, batch // len(by_label))) for b in by_label])
        x, n = wins[pick], len(pick)
        patches = np.lib.stride_tricks.sliding_window_view(x, 4, axis=1)
        cols = p["e"][patches].reshape(n * WINDOW, -1)
        z = (cols @ p["w"]).reshape(n, WINDOW, f)
        best = z.argmax(1)
        top = np.take_along_axis(z, best[:, None], 1)[:, 0] + p["b"]
        act = np.maximum(top, 0)
        logits = act @ p["h"] + p["c"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        d = q
        d[np.arange(n), y[pick]] -= 1
        d /= n
        da = (d @ p["h"].T) * (top > 0)
        won = cols.reshape(n, WINDOW, -1)[np.arange(n)[:, None], best]          # n x f x 4 d
        gw = np.einsum("nf,nfk->kf", da, won) * mask
        gcols = da[:, :, None] * p["w"].T[None]                                  # n x f x 4 d
        ge = np.zeros_like(p["e"])
        np.add.at(ge, patches[np.arange(n)[:, None], best].reshape(-1), gcols.reshape(-1, dims))
        grads = {"e": ge, "w": gw, "b": da.sum(0), "h": act.T @ d, "c": d.sum(0)}
        rate = 0.01 * (1 - step / (steps + 1))
        for k, g in grads.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)
    return Network(names, p["e"], p["w"] * mask, p["b"], p["h"], p["c"])


# 25 MB a network: a worker keeps those of the last one only
@lru_cache(maxsize=1)
def _pair_tables(key: bytes, shape: tuple[int, int], filters: bytes, f: int) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(key, np.float32).reshape(shape)
    w = np.frombuffer(filters, np.float32).reshape(4, shape[1], f)
    part = np.einsum("bd,odf->obf", e, w)
    pair = lambda a, b: (part[a][:, None] + part[b][None]).reshape(65536, f).astype(np.float32)
    return pair(0, 1), pair(2, 3)


def probabilities(net: Network, wins: np.ndarray, batch: int = 48) -> np.ndarray:
    """Softmax of each window."""
    f = net.filters.shape[1]
    left, right = _pair_tables(net.embedding.tobytes(), net.embedding.shape, net.filters.tobytes(), f)
    out = np.empty((len(wins), len(net.labels)), np.float32)
    for s in range(0, len(wins), batch):
        x = wins[s:s + batch].astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        z = left[pairs[:, :WINDOW]]
        z += right[pairs[:, 2:]]
        act = np.maximum(z.max(1) + net.bias, 0)
        logits = act @ net.head + net.head_bias
        q = np.exp(logits - logits.max(1, keepdims=True))
        out[s:s + batch] = q / q.sum(1, keepdims=True)
    return out


def text_distributions(net: Network, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One row per text: the mean of its windows, weighted by their bytes; zeros for an empty text."""
    total = np.zeros((len(limits) - 1, len(net.labels)))
    for a, b in common.row_blocks(limits, 1 << 20):
        step = WINDOW * 8192
        for lo in range(int(limits[a]), max(int(limits[b]), int(limits[a]) + 1), step) if b == a + 1 else [None]:
            # a single long row goes through in slices of whole windows
            own = limits[a:b + 1] if lo is None else np.array([lo, min(lo + step, int(limits[b]))])
            wins, row, size = windows_of(data, own)
            if len(row):
                np.add.at(total, a + row, probabilities(net, wins) * size[:, None])
    sums = total.sum(1, keepdims=True)
    return np.divide(total, sums, out=np.zeros_like(total), where=sums > 0)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 1500,
        most_labels: int = 200, seed: int = 3) -> Network | None:
    """Train on at most ``2 * per_label`` texts of each label (a bounded sample by hash of the key); each text
    gives at most its first 2,000 characters. None if no row has a label and a text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where("t is not null and l is not null and t rlike '\\\\p{L}'")
    got = common.bounded_sample(rows, "l", "t", "k", per_label, most_labels, seed).select("k", F.substring("t", 1, 2000).alias("t"), "l").collect()
    got.sort(key=lambda r: (str(r["k"]), r["t"]))
    return train([r["t"] for r in got], [r["l"] for r in got]) if got else None


def predict(docs: DataFrame, net: Network | None, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted label and its probability to every row.

    A null text or one without a letter gets ``und`` and 0.0; so does every text if there is no network.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    mark = "_lid_letters"
    marked = docs.withColumn(mark, F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField(to[0], StringType()), StructField(to[1], DoubleType())])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            letters = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            names, scores = [UNDETERMINED] * rows, np.zeros(rows)
            if net is not None and rows:
                dist = text_distributions(net, *common.buffers(batch.column(place)))
                best = dist.argmax(1)
                scores = np.where(letters, np.minimum(1.0, dist[np.arange(rows), best]), 0.0)
                names = [net.labels[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[f.name for f in schema.fields])

    return marked.mapInArrow(run, schema)


def op3_language_id(spark, folder: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang", common.fold_of(F.col("doc_id"), 3).alias("fold"))
    net = fit(docs.where("fold <> 1"))
    return predict(docs.select("doc_id", (F.col("fold") == 1).alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark, docs: DataFrame, folder: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: train on the rows' own labels, drop texts that the network rejects.

    Rejected: no letter at all, or no language with a probability of ``least``.
    """
    net = fit(docs)
    pred, score = "_lid_pred", "_lid_score"
    out = predict(docs, net, to=(pred, score))
    return out.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
