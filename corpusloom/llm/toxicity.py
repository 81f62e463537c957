"""Toxicity with a subsequence string-kernel support vector machine and Nystroem landmarks.

The kernel compares two words by their common subsequences of four characters, each weighted by LAMBDA to the
number of characters it skips, within a span of SPAN characters. Insults with gaps, swapped endings or
inserted characters ("i-d-i-o-t", "idi0ot") still share most of their subsequences. Runs of single characters
("i d i o t") are joined to one word.

Training on labelled sentences: a sentence is the bag of its words, and a sentence's response is its largest word
response. Sentences of toxic texts count as toxic through the words that mark toxic texts (their witnesses),
sentences of clean texts are clean; hard negatives are added in rounds. The support vector machine works on the
Nystroem features K(word, landmarks) K(landmarks, landmarks)^(-1/2). As it is linear in the kernel and the kernel is
linear in subsequences, the whole machine collapses to one weight per subsequence of the landmarks, which
gives the same response without comparing every word with every landmark.

A text's score is a logistic function of the largest response of its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

LAMBDA = 0.6
SPAN = 7
CODES = 32
#: Responses below it count as it: such words are far from every insult.
FLOOR = 0.1
KEPT_WORDS = 600_000
#: Places of a subsequence's characters after its first one, and its weight.
SHAPES = [(places, LAMBDA ** (places[-1] - 3)) for places in combinations(range(1, SPAN), 3)]
ALL = CODES ** 4
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’„…–—"
_NO_MARKS = {ord(c): None for c in PUNCTUATION}
SPACED = re.compile(r"(?:(?<!\S)\S[ \t]+){2,}\S(?!\S)")


@dataclass(frozen=True)
class Machine:
    """Weights of subsequences (ids and values, a few thousand) and the logistic function of the response."""
    ids: np.ndarray
    values: np.ndarray
    slope: float
    offset: float


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    """Character to code: 1-26 letters without their accents, 27 and 28 the ends of a word, 29-31 all others; 0 is no character."""
    t = (29 + np.arange(0x110000) % 3).astype(np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= base <= "z":
            t[c] = 1 + ord(base) - 97
    t[ord("ß")] = 1 + ord("s") - 97
    return t


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, each between its end marks and followed by zeros wider than any span; starts of the words."""
    gap = "\x01" * (SPAN - 1)
    joined = "".join(f"\x02{w}\x03{gap}" for w in words)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _code_table()[raw]
    out[raw == 2], out[raw == 3], out[raw == 1] = 27, 28, 0
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) + 2 + SPAN - 1
    return out, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def subsequences(codes: np.ndarray):
    """For each shape: the id of the subsequence that starts at every place (0 if one of its places is empty), and its weight."""
    x = np.concatenate([codes, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(codes)
    for places, weight in SHAPES:
        ids, whole = x[:n], x[:n] > 0
        for at in places:
            ids = ids * CODES + x[at:at + n]
            whole = whole & (x[at:at + n] > 0)
        yield np.where(whole, ids, 0), weight


def _norms(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square root of every word's kernel with itself."""
    n = len(starts)
    word = np.repeat(np.arange(n), np.diff(np.append(starts, len(codes))))
    ids, weights = [], []
    for own, weight in subsequences(codes):
        at = np.flatnonzero(own)
        ids.append(word[at].astype(np.int64) * ALL + own[at])
        weights.append(np.full(len(at), weight))
    ids, weights = np.concatenate(ids), np.concatenate(weights)
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], weights[order]
    if not len(ids):
        return np.ones(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
    phi = np.add.reduceat(weights, first)
    out = np.zeros(n)
    np.add.at(out, ids[first] // ALL, phi * phi)
    return np.sqrt(np.where(out > 0, out, 1.0))


@lru_cache(maxsize=2)
def _weights(ids: bytes, values: bytes) -> np.ndarray:
    t = np.zeros(ALL, np.float32)
    t[np.frombuffer(ids, np.int32)] = np.frombuffer(values, np.float32)
    t[0] = 0
    return t


def responses(machine: Machine, words: list[str]) -> np.ndarray:
    """Response of every word, at least FLOOR. Only words whose bound passes FLOOR get their exact norm."""
    out = np.full(len(words), FLOOR)
    if not words:
        return out
    table = _weights(machine.ids.tobytes(), machine.values.tobytes())
    for s in range(0, len(words), 20_000):
        part = words[s:s + 20_000]
        codes, starts = coded(part)
        raw, least = np.zeros(len(codes), np.float32), np.zeros(len(codes), np.float32)
        for ids, weight in subsequences(codes):
            raw += table[ids] * np.float32(weight)
            least += (ids > 0) * np.float32(weight * weight)
        raw, least = np.add.reduceat(raw, starts), np.add.reduceat(least, starts)
        near = np.flatnonzero(raw > FLOOR * np.sqrt(np.maximum(least, 1e-9)))
        if len(near):
            own = [part[i] for i in near]
            out[s + near] = np.maximum(FLOOR, raw[near] / _norms(*coded(own)))
    return out


def units(text: str) -> set[str]:
    """Distinct words of a text without their outer punctuation, and its runs of single characters joined."""
    low = text.lower()
    out = set()
    for w in set(low.split()):
        if len(w) > 64:         # a very long run is cut into overlapping pieces, so nothing of it is lost
            out.update(w[i:i + 64].strip(PUNCTUATION) for i in range(0, len(w), 48))
            continue
        w = w.strip(PUNCTUATION)
        out.add(w)
        if w and not w.isalnum():
            out.add(w.translate(_NO_MARKS))
    out.update(re.sub(r"\s", "", m)[i:i + 64] for m in SPACED.findall(low) for i in range(0, len(m), 48))
    out.discard("")
    return out


def _features(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    codes, starts = coded(marks)
    norms = _norms(codes, starts)
    place = np.zeros(ALL, np.int32)
    word = np.repeat(np.arange(len(marks)), np.diff(np.append(starts, len(codes))))
    rows = [(ids, word, weight) for ids, weight in subsequences(codes)]
    seen = np.unique(np.concatenate([ids for ids, _, _ in rows]))
    seen = seen[seen > 0]
    place[seen] = np.arange(1, len(seen) + 1)
    phi = np.zeros((len(seen) + 1, len(marks)), np.float32)
    for ids, w, weight in rows:
        at = ids > 0
        np.add.at(phi, (place[ids[at]], w[at]), weight)
    phi /= norms
    out = np.empty((len(words), len(marks)), np.float32)
    for s in range(0, len(words), 500):
        part = words[s:s + 500]
        codes, starts = coded(part)
        k = np.zeros((len(codes), len(marks)), np.float32)
        for ids, weight in subsequences(codes):
            k += phi[place[ids]] * np.float32(weight)
        out[s:s + 500] = np.add.reduceat(k, starts, axis=0) / _norms(codes, starts)[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, rounds: int = 1000) -> np.ndarray:
    """Squared hinge loss with an L2 penalty; the bias is the last column of x. Accelerated gradient descent."""
    step = 1.0 / (1.0 + 2 * c * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2)
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * x.T @ (weight * slack * y))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def _logistic(r: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | response), classes weighted evenly, slightly regularised."""
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    mid, wide = r.mean(), max(float(r.std()), 1e-6)
    x = np.stack([(r - mid) / wide, np.ones(len(r))], axis=1)
    ridge = np.array([1e-3, 1e-6])
    loss = lambda v: (w * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + (ridge * v * v).sum() / 2
    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * v
        d = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), g)
        step = 1.0
        while loss(v - step * d) > loss(v) and step > 1e-6:
            step /= 2
        v = v - step * d
        if np.abs(step * d).max() < 1e-9:
            break
    return float(v[0] / wide), float(v[1] - v[0] * mid / wide)


def train(texts: list[str], toxic: list[int], landmarks: int = 320, rounds: int = 4, seed: int = 5) -> Machine | None:
    """None if one of the two labels is missing."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    one = {}
    whole = [{one.setdefault(u, u) for s in re.split(r"(?<=[.!?])\s+|\n", t) for u in units(s)} for t in texts]
    seen = {k: Counter(u for own, l in zip(whole, y) if l == k for u in own) for k in (0, 1)}
    n1, n0 = int(y.sum()), int((y == 0).sum())
    odds = {u: np.log((c + 0.1) / n1) - np.log((seen[0][u] + 0.1) / n0) for u, c in seen[1].items() if len(u) > 2}
    strong = sorted((u for u, o in odds.items() if o > 2.5 and seen[1][u] >= 3), key=lambda u: (-seen[1][u], u))
    if not strong:
        strong = sorted(odds, key=lambda u: (-odds[u], u))[:50]
    # witnesses: the marked words of toxic sentences
    positive = strong[:2000]
    clean = sorted(seen[0], key=lambda u: (-seen[0][u], u))
    negative = clean[:1500] + [clean[i] for i in rng.permutation(np.arange(1500, len(clean)))[:2500]] if len(clean) > 1500 else clean
    hard = []
    machine = None
    for turn in range(rounds):
        # landmarks: in the order of the pool, each one that no earlier landmark of its side resembles
        marks = []
        for pool, most in ((positive[:600], landmarks // 2), (hard + clean[:600], landmarks - landmarks // 2)):
            near, own = _features(pool, pool), []
            for i in range(len(pool)):
                if len(own) < most and (not own or near[i, own].max() < 0.75):
                    own.append(i)
            marks += [pool[i] for i in own]
        marks = sorted(set(marks))
        values, vectors = np.linalg.eigh(_features(marks, marks).astype(np.float64))
        keep = values > 1e-5 * values.max()
        half = vectors[:, keep] / np.sqrt(values[keep])
        z = np.vstack([_features(positive, marks), _features(negative, marks)]) @ half
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        often = np.sqrt([seen[1][u] for u in positive])      # a witness of many sentences weighs more
        share = np.concatenate([0.5 * often / often.sum(), np.full(len(negative), 0.5 / max(1, len(negative)))])
        x = np.hstack([z, np.ones((len(z), 1))])
        w = _svm(x, target, share)
        beta = half @ w[:-1]
        codes, starts = coded(marks)
        per = beta / _norms(codes, starts)
        word = np.repeat(np.arange(len(marks)), np.diff(np.append(starts, len(codes))))
        table = np.zeros(ALL)
        for ids, weight in subsequences(codes):
            np.add.at(table, ids, per[word] * weight)
        table[0] = 0
        ids = np.flatnonzero(table).astype(np.int32)
        machine = Machine(ids, table[ids].astype(np.float32), 1.0, 0.0)
        if turn + 1 < rounds:
            # hard negatives: the clean words of largest response
            pool = [clean[i] for i in rng.permutation(len(clean))[:200_000]]
            r = responses(machine, pool)
            worst = [pool[i] for i in np.argsort(-r, kind="stable")[:2000]]
            negative, hard = sorted(set(negative) | set(worst)), worst[:800]
    known = {}
    every = sorted(set().union(*whole))
    known = dict(zip(every, responses(machine, every)))
    top = np.array([max((known[u] for u in own), default=FLOOR) for own in whole])
    slope, offset = _logistic(top, y)
    return Machine(machine.ids, machine.values, slope, offset)


def score(docs: DataFrame, machine: Machine | None, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of every whole text. Null and empty texts have the score of the smallest response; without a machine every score is 0."""
    schema = StructType([*docs.schema.fields, StructField(to, DoubleType())])
    place = docs.columns.index(text)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if machine is not None:
                limits = common.buffers(batch.column(place))[1]
                for a, b in common.row_blocks(limits, 1 << 20):
                    own = [units(t or "") for t in batch.column(place).slice(a, b - a).to_pylist()]
                    if len(known) > KEPT_WORDS:
                        known.clear()
                    fresh = sorted(set().union(*own) - known.keys())
                    known.update(zip(fresh, responses(machine, fresh).tolist()))
                    top = np.array([max(map(known.__getitem__, u), default=FLOOR) for u in own])
                    out[a:b] = 1 / (1 + np.exp(-np.clip(machine.slope * top + machine.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 1500, seed: int = 3) -> Machine | None:
    """Train on at most ``2 * per_label`` labelled texts of each label (a bounded sample by hash of the key), of each at most 20,000 characters.

    The ids are chosen from the narrow labels first; the bounded table of ids is broadcast, so texts are not shuffled.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("l")).where("k is not null and l in (0, 1)").groupBy("k").agg(F.max("l").alias("l"))
    chosen = common.bounded_sample(rows, "l", "", "k", per_label, 2, seed)
    own = docs.select(F.col(key).alias("k"), F.substring(F.col(text), 1, 20_000).alias("t")).where("t is not null")
    got = own.join(F.broadcast(chosen), "k").select("k", "t", "l").limit(8 * per_label).collect()
    got.sort(key=lambda r: (str(r["k"]), r["t"]))
    return train([r["t"] for r in got], [r["l"] for r in got])


def op1_toxicity(spark, folder: str) -> DataFrame:
    """Score of every document; rows with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    labels = common.table(spark, folder, "labels")
    fold = common.fold_of(F.col("doc_id"), 5)
    machine = fit(docs, labels.where(fold != 0))
    out = score(docs, machine)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
