"""Scoring of rows against a bounded set of queries inside map tasks.

A join of postings with the terms of many queries makes one row per (query, chunk, shared term) and
shuffles a sum per (query, chunk). Here each task multiplies its rows with the query block and keeps
the best k per query, so only tasks x queries x k rows are shuffled. The block is bounded and counted
by the caller; beyond the bound the join is used.

Products are sparse: a posting meets the queries that have its term, through row pointers. With upper bounds of term
values, a term is opened for a query only as long as a row without its other terms could still get among the k best
(max-score): the heaviest terms of a query find the candidates, and common terms are looked up for candidates only.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import scores as S
from .vectors import _best

QUERIES_PER_BLOCK = 256
ROWS_PER_STEP = 1000
#: The same for keywords, whose counts are dense, and words whose query words a task remembers.
KEYWORD_ROWS = 250
KNOWN = 300_000
#: Products (posting x query) that a step holds at once.
PRODUCTS = 4_000_000
#: Terms of a candidate that are looked up in the time of a product.
LOOKED_UP = 8


class Best:
    """The k best (score, id) per query seen so far by one task."""

    def __init__(self, queries: int, k: int):
        self.kept: list = [None] * queries
        self.least = np.full(queries, -np.inf)  # the k-th best score, once there are k
        self.k = k

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if self.kept[q] is not None:
            old_s, old_i = self.kept[q]
            if len(old_s) == self.k:
                near = scores >= old_s[-1]
                scores, ids = scores[near], ids[near]
            scores, ids = np.concatenate([old_s, scores]), np.concatenate([old_i, ids])
        at = _best(scores, ids, self.k)
        self.kept[q] = (scores[at], ids[at])
        if len(at) == self.k:
            self.least[q] = scores[at[-1]]

    def batches(self, query_ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        parts = [(q, s, i) for q, hit in zip(query_ids, self.kept) if hit is not None for s, i in zip(*hit)]
        if parts:
            q, s, i = zip(*parts)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s, pa.float64())], names=names)


def _flat(column: pa.ListArray, field: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each element, terms, values) of an array<struct<term, value>> column."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return (np.repeat(np.arange(len(column)), lengths), flat.field("term"),
            flat.field(field).to_numpy(zero_copy_only=False).astype("float64"))


def _schema(rows: DataFrame, q_type: str, key: str) -> str:
    return f"query_id {q_type}, `{key}` {rows.schema[key].dataType.simpleString()}, score double"


class Products:
    """The term weights of a block of queries as sparse columns, with upper bounds per entry."""

    def __init__(self, table: pd.DataFrame, query_ids: np.ndarray):
        self.terms, t = np.unique(table["term"].to_numpy(dtype=object), return_inverse=True)
        self.queries = len(query_ids)
        q = np.searchsorted(query_ids, table["query_id"])
        w, most = table["w"].to_numpy("float64"), table["most"].to_numpy("float64")
        # max-score needs terms that can only add; a shared term that adds nothing is a hit as well
        self.bounded = bool(len(w)) and bool((w > 0).all() and np.isfinite(most).all())
        order = np.lexsort((q, t))
        self.term, self.query, self.w = t[order], q[order], w[order]
        self.upper = (w * most)[order] if self.bounded else np.zeros(len(w))
        if self.bounded:
            # sum of the bounds of a query's terms up to and with this one, smallest first
            by = np.lexsort((self.upper, self.query))
            total = np.cumsum(self.upper[by])
            first = np.searchsorted(self.query[by], np.arange(self.queries))
            before = np.concatenate([[0.0], total])[first]
            self.upto = np.empty(len(by))
            self.upto[by] = total - before[self.query[by]]

    def opened(self, least: np.ndarray) -> np.ndarray:
        """Entries that a row needs one of to reach the k best: the others together stay below the k-th score."""
        if not self.bounded:
            return np.ones(len(self.term), bool)
        return self.upto >= least[self.query] - 2e-6

    def sums(self, entries: np.ndarray, row: np.ndarray, col: np.ndarray, amount: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Sums and numbers of shared entries, rows x queries, and the products made."""
        term, query, w = self.term[entries], self.query[entries], self.w[entries]
        start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        reps = (start[1:] - start[:-1])[col]
        out, seen = np.zeros(rows * self.queries), np.zeros(rows * self.queries)
        ends = np.cumsum(reps)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PRODUCTS, side="right")))
            own = reps[a:b]
            at = np.repeat(start[col[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            cell = np.repeat(row[a:b], own) * self.queries + query[at]
            out += np.bincount(cell, weights=np.repeat(amount[a:b], own) * w[at], minlength=len(out))
            seen += np.bincount(cell, minlength=len(out))
            a = b
        return out.reshape(rows, -1), seen.reshape(rows, -1), int(reps.sum())

    def rest(self, entries: np.ndarray, row: np.ndarray, col: np.ndarray, amount: np.ndarray, at_row: np.ndarray, at_query: np.ndarray, rows: int) -> tuple[np.ndarray, int]:
        """What the other entries add to candidates (row, query), and the products made or the candidates looked up."""
        per_term = np.bincount(self.term[entries], minlength=len(self.terms))
        asked = np.zeros(rows, bool)
        asked[at_row] = True
        near = asked[row] & (per_term[col] > 0)
        if len(at_row) * np.count_nonzero(per_term) <= LOOKED_UP * per_term[col[near]].sum():
            return self.looked_up(entries, row, col, amount, at_row, at_query), len(at_row)
        sums, _, made = self.sums(entries, row[near], col[near], amount[near], rows)
        return sums[at_row, at_query], made

    def looked_up(self, entries: np.ndarray, row: np.ndarray, col: np.ndarray, amount: np.ndarray, at_row: np.ndarray, at_query: np.ndarray) -> np.ndarray:
        """What the other entries add to candidates (row, query)."""
        used = np.unique(self.term[entries])
        place = np.full(len(self.terms) + 1, -1)
        place[used] = np.arange(len(used))
        rows, compact = np.unique(at_row, return_inverse=True)
        number = np.full(int(max(row.max(initial=0), at_row.max(initial=0))) + 1, -1)
        number[rows] = np.arange(len(rows))
        near = (place[col] >= 0) & (number[row] >= 0)
        m = np.zeros((len(rows), len(used)))
        m[number[row[near]], place[col[near]]] = amount[near]
        weights = np.zeros((self.queries, len(used)))
        weights[self.query[entries], place[self.term[entries]]] = self.w[entries]
        out = np.empty(len(at_row))
        step = max(1, PRODUCTS // max(1, len(used)))
        for a in range(0, len(out), step):
            out[a:a + step] = np.einsum("ij,ij->i", m[compact[a:a + step]], weights[at_query[a:a + step]])
        return out


def top_k_products(rows: DataFrame, weights: DataFrame, k: int, field: str,
                   value: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "chunk_id",
                   length: str | None = None, products: tuple | None = None) -> DataFrame:
    """Top k of sum(query weight * value(field, length)) over shared terms.

    rows = (key, [length], terms array<struct<term, field>>); weights = (query_id, term, w[, most]), bounded. ``most`` is the
    largest value of the term in any row; without it, or with weights of 0 or less, all terms are opened. ``products`` = two
    accumulators for the products made and those that opening everything would make.
    """
    table = weights.toPandas()  # bounded: counted by the caller
    if "most" not in table:
        table["most"] = np.inf
    query_ids = np.sort(table["query_id"].unique())
    blocks = []
    for at in range(0, len(query_ids), QUERIES_PER_BLOCK):
        own = query_ids[at:at + QUERIES_PER_BLOCK]
        blocks.append((at, Products(table[table["query_id"].isin(own)], own)))
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, blocks))
    names = ["query_id", key, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, found = shared.value
        sets = [pa.array(list(p.terms), pa.string()) for _, p in found]
        best = Best(len(ids_of), k)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_STEP):
                batch = whole.slice(start, ROWS_PER_STEP)
                row, terms, amount = _flat(batch.column("terms"), field)
                size = (batch.column(length).to_numpy(zero_copy_only=False).astype("float64")[row]
                        if length else np.ones(len(row)))
                amount = value(amount, size)
                ids = batch.column(key).to_numpy(zero_copy_only=False)
                coded = terms.dictionary_encode()
                for (at, p), wanted in zip(found, sets):
                    of = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1).to_numpy(zero_copy_only=False)
                    col = of[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, np.int64)
                    hit = col >= 0
                    r, c, x = row[hit], col[hit], amount[hit]
                    least = best.least[at:at + p.queries]
                    entries = p.opened(least)
                    sums, seen, made = p.sums(np.flatnonzero(entries), r, c, x, batch.num_rows)
                    match = seen > 0
                    if not entries.all():
                        closed = np.flatnonzero(~entries)
                        rest = np.bincount(p.query[closed], weights=p.upper[closed], minlength=p.queries)
                        match &= sums + rest >= least - 2e-6
                        i, q = np.nonzero(match)
                        if len(i):
                            # few candidates are looked up; for many the products of the closed terms are less work
                            rest, more = p.rest(closed, r, c, x, i, q, batch.num_rows)
                            sums[i, q] += rest
                            made += more
                    scores = np.round(sums, 6)
                    for q in np.flatnonzero(match.any(axis=0)):
                        ok = match[:, q]
                        best.add(at + q, scores[ok, q], ids[ok])
                    if products:
                        products[0].add(made)
                        products[1].add(int(np.bincount(p.term, minlength=len(p.terms))[c].sum()))
        yield from best.batches(ids_of, names)

    q_type = weights.schema["query_id"].dataType.simpleString()
    columns = [key, "terms"] + ([length] if length else [])
    return S.top_k(rows.select(*columns).mapInArrow(run, _schema(rows, q_type, key)), k, tie=key)


def all_products(rows: DataFrame, weights: DataFrame, field: str, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): sums of query weight * value over shared terms, for every row and query that share one. Nothing is shuffled.

    rows = (key, terms array<struct<term, field>>); weights = (query_id, term, w), bounded.
    """
    table = weights.toPandas().assign(most=np.inf)  # bounded: counted by the caller
    query_ids = np.sort(table["query_id"].unique())
    blocks = []
    for at in range(0, len(query_ids), QUERIES_PER_BLOCK):
        own = query_ids[at:at + QUERIES_PER_BLOCK]
        blocks.append((own, Products(table[table["query_id"].isin(own)], own)))
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    names = ["query_id", key, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(own, p, pa.array(list(p.terms), pa.string())) for own, p in shared.value]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_STEP):
                batch = whole.slice(start, ROWS_PER_STEP)
                row, terms, amount = _flat(batch.column("terms"), field)
                for own, p, wanted in found:
                    col = pc.fill_null(pc.index_in(terms, value_set=wanted), -1).to_numpy(zero_copy_only=False)
                    hit = col >= 0
                    sums, seen, _ = p.sums(np.arange(len(p.term)), row[hit], col[hit], amount[hit], batch.num_rows)
                    i, q = np.nonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), batch.column(key).take(pa.array(i)), pa.array(sums[i, q])], names=names)

    q_type = weights.schema["query_id"].dataType.simpleString()
    return rows.select(key, "terms").mapInArrow(run, _schema(rows, q_type, key))


def unit_weights(rows: DataFrame, idf: DataFrame, key: str = "chunk_id", rare: str | None = None) -> DataFrame:
    """(key, terms array<struct<term,weight>>): tf times idf, rows of unit length, for a bounded idf table.

    ``rare`` = a column array<struct<term, idf>> of rows with the terms that the table lacks.
    """
    table = idf.select("term", "idf").toPandas()  # bounded: counted by the caller
    shared = rows.sparkSession.sparkContext.broadcast((list(table["term"]), table["idf"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf_of = shared.value
        known = pa.array(words, pa.string())
        for batch in batches:
            row, terms, tf = _flat(batch.column("terms"), "tf")
            at = pc.index_in(terms, value_set=known)
            values = idf_of[pc.fill_null(at, 0).to_numpy(zero_copy_only=False)] if len(row) and len(idf_of) else np.zeros(len(row))
            lacking = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False)) if len(row) else []
            if len(lacking):
                _, own, own_idf = _flat(batch.column(rare), "idf")
                values[lacking] = own_idf[pc.index_in(terms.take(pa.array(lacking)), value_set=own).to_numpy(zero_copy_only=False)]
            raw = tf * values
            norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=batch.num_rows)) if len(row) else np.ones(batch.num_rows)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows)) if len(row) else np.zeros(batch.num_rows)
            offsets = pa.array(np.concatenate([[0], ends]).astype("int32"))
            pairs = pa.StructArray.from_arrays([terms, pa.array(raw / norm[row])], names=["term", "weight"])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pairs)], names=[key, "terms"])

    kind = rows.schema[key].dataType.simpleString()
    columns = [key, "terms"] + ([rare] if rare else [])
    return rows.select(*columns).mapInArrow(run, f"`{key}` {kind}, terms array<struct<term: string, weight: double>>")


def _finder(words: list[str]) -> Callable[[str], list[int]]:
    """Positions of the words that occur in a text."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [i for i, w in enumerate(words) if w in text]
    machine = ahocorasick.Automaton()
    for i, w in enumerate(words):
        machine.add_word(w, i)
    machine.make_automaton()
    return lambda text: list({i for _, i in machine.iter(text)})


class Inside:
    """Which query words occur in a word of the texts, and how often; numbered lists in flat arrays."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.words, self.counts, self.limits = array("i"), array("i"), array("q", [0])

    def numbers(self, terms: list[str], find: Callable[[str], list[int]], words: list[str], most: int) -> np.ndarray:
        if len(self.known) > most:
            self.__init__()
        known = self.known
        for term in terms:
            if term not in known:
                at = find(term)
                self.words.extend(at)
                self.counts.extend([term.count(words[i]) for i in at])
                known[term] = len(self.limits) - 1
                self.limits.append(len(self.words))
        return np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.words, np.int64), np.array(self.counts, np.float64), np.array(self.limits, np.int64)


def top_k_keywords(rows: DataFrame, wanted: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Top k of (shared words / query words + 0.1 * occurrences of query words inside words).

    rows = (key, terms array<struct<term, tf>>); wanted = (query_id, n_words, word), bounded. Each
    different word of a task is searched once.
    """
    table = wanted.select("query_id", "n_words", "word").toPandas()  # bounded: counted by the caller
    query_ids = np.sort(table["query_id"].unique())
    blocks = []
    for at in range(0, len(query_ids), QUERIES_PER_BLOCK):
        part = table[table["query_id"].isin(query_ids[at:at + QUERIES_PER_BLOCK])]
        words, w = np.unique(part["word"].to_numpy(dtype=object), return_inverse=True)
        q = np.searchsorted(query_ids, part["query_id"]) - at
        asked = np.zeros((len(words), min(QUERIES_PER_BLOCK, len(query_ids) - at)))
        asked[w, q] = 1.0
        n = np.ones(asked.shape[1])
        n[q] = part["n_words"]
        blocks.append((at, list(words), asked, n))
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, blocks))
    names = ["query_id", key, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, found = shared.value
        best = Best(len(ids_of), k)
        state = [(_finder(words), {w: i for i, w in enumerate(words)}, Inside()) for _, words, _, _ in found]
        for whole in batches:
            for start in range(0, whole.num_rows, KEYWORD_ROWS):
                batch = whole.slice(start, KEYWORD_ROWS)
                row, terms, tf = _flat(batch.column("terms"), "tf")
                coded = terms.dictionary_encode()
                code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                ids = batch.column(key).to_numpy(zero_copy_only=False)
                for (at, words, asked, n), (find, place, known) in zip(found, state):
                    number = known.numbers(distinct, find, words, KNOWN // len(found))
                    all_words, all_counts, limits = known.arrays()
                    first, sizes = limits[number], limits[number + 1] - limits[number]
                    reps = sizes[code]
                    pick = np.repeat(first[code] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                    cell = np.repeat(row, reps) * len(words) + all_words[pick]
                    times = np.bincount(cell, weights=np.repeat(tf, reps) * all_counts[pick],
                                        minlength=batch.num_rows * len(words)).reshape(batch.num_rows, -1)
                    same = np.zeros_like(times)
                    exact = np.array([place.get(term, -1) for term in distinct])[code]
                    same[row[exact >= 0], exact[exact >= 0]] = 1.0
                    scores = np.round((same @ asked) / n + 0.1 * (times @ asked), 6)
                    for q in range(asked.shape[1]):
                        ok = (scores[:, q] > 0) & (scores[:, q] >= best.least[at + q])
                        best.add(at + q, scores[ok, q], ids[ok])
        yield from best.batches(ids_of, names)

    q_type = wanted.schema["query_id"].dataType.simpleString()
    return S.top_k(rows.select(key, "terms").mapInArrow(run, _schema(rows, q_type, key)), k, tie=key)
