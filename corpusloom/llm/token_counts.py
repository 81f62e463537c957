"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

The merges are compiled to a deterministic transducer over bytes. Its state is what later merges can still
see: the longest suffix that begins a token, and the token and the count at each place inside it. Each
transition is annotated with the number of tokens that it adds to the count (0 or less where a merge takes
tokens back), so the count of a piece of text is a sum over its path. States and transitions are compiled when a
text first needs them and are kept in a hash table; there are finitely many, as suffixes are no longer
than the longest token.

Texts are cut into chunks of equal length that run in lockstep, one numpy step per byte for thousands of
chunks. The map of a chunk takes the state before it to (state after it, tokens): a word start inside the chunk
resets the state, so the map is "run the head before the first word start from the given state; from there on the
result is constant". Maps of consecutive chunks compose associatively; a parallel prefix scan finds for
every chunk where its entry state comes from, and the heads run in a second lockstep.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import common

MODEL = "byte_bpe_50k.json"
OVER = 512
CHUNK = 256
#: Compiled transitions that a worker keeps; beyond it compilation starts anew.
KEPT = 2_000_000


def byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule of byte-level vocabularies: printable Latin-1 stands for itself, the others for letters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in printable):
        out[chr(256 + n)] = b
    return out


class Transducer:
    """Compiled on demand from one tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        names = [bytes([b]) for b in range(256)]
        ids = {n: i for i, n in enumerate(names)}
        self.rank, self.parts, self.joins = [-1] * 256, [None] * 256, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            i = ids.setdefault(a + b, len(names))
            if i < len(names):
                raise ValueError("two merges make one token")
            names.append(a + b)
            self.rank.append(rank)
            self.parts.append((ids[a], ids[b]))
            self.joins[ids[a] << 20 | ids[b]] = rank
        self.names = names
        step, piece, depth = {}, [-1], [0]
        for n, i in ids.items():
            node = 0
            for c in n:
                key = node << 8 | c
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                    depth.append(depth[node] + 1)
                node = step[key]
            piece[node] = i
        fail = [0] * len(piece)
        ends: list[tuple] = [()] * len(piece)
        parent = {v: k for k, v in step.items()}
        for node in sorted(range(1, len(piece)), key=depth.__getitem__):
            up, c = parent[node] >> 8, parent[node] & 255
            if up:
                f = fail[up]
                while f and f << 8 | c not in step:
                    f = fail[f]
                fail[node] = step.get(f << 8 | c, 0)
            ends[node] = (((piece[node], depth[node]),) if piece[node] >= 0 else ()) + ends[fail[node]]
        self.step, self.fail, self.depth, self.ends = step, fail, depth, ends
        self.start_over()

    def start_over(self) -> None:
        self.follows: dict[int, bool] = {}
        #: state: (automaton node, tokens that end at this place and the places before, counts relative to this place)
        self.states = [(0, (-1,), (0,))]
        self.index = {self.states[0]: 0}
        size = 1 << 16
        self.keys, self.to, self.adds, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8), 0

    def _may_follow(self, a: int, b: int) -> bool:
        """True if merging would leave the border between tokens a and b alone: undo the later merge of both sides, step by step."""
        limit = (float("inf"), 1)
        while True:
            joint = self.joins.get(a << 20 | b)
            if joint is not None and (joint, 1) < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = (ra, 0), self.parts[a][1]
            else:
                limit, b = (rb, 2), self.parts[b][0]

    def _compile(self, state: int, c: int) -> tuple[int, int]:
        """Next state and tokens added."""
        node, tokens, counts = self.states[state]
        while node and node << 8 | c not in self.step:
            node = self.fail[node]
        node = self.step.get(node << 8 | c, 0)
        for p, size in self.ends[node]:
            before = tokens[size - 1]
            if before < 0:
                ok = True
            else:
                ok = self.follows.get(before << 20 | p)
                if ok is None:
                    ok = self.follows[before << 20 | p] = self._may_follow(before, p)
            if ok:
                added = counts[size - 1] + 1
                break
        else:
            raise ValueError("a byte without a token")
        depth = self.depth[node]
        new = (node, (p, *tokens[:depth]), (0, *[x - added for x in counts[:depth]]))
        to = self.index.get(new)
        if to is None:
            to = self.index[new] = len(self.states)
            self.states.append(new)
        return to, added

    # -- hash table of transitions --------------------------------------------------------------------
    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, or of the empty place where it belongs."""
        mask = len(self.keys) - 1
        slot = ((keys * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(24)) & mask
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return slot

    def _insert(self, keys: list[int], to: list[int], adds: list[int]) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, t, a = self.keys[old], self.to[old], self.adds[old]
            size = len(self.keys)
            while 2 * (self.used + len(keys)) > size:
                size *= 4
            self.keys, self.to, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)
            self._place(k, t, a)
        self._place(np.array(keys, np.int64), np.array(to, np.int32), np.array(adds, np.int8))
        self.used += len(keys)

    def _place(self, keys, to, adds) -> None:
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left])
            # of keys that want one empty slot the first takes it
            _, first = np.unique(slot, return_index=True)
            now = left[first]
            self.keys[slot[first]], self.to[slot[first]], self.adds[slot[first]] = keys[now], to[now], adds[now]
            left = np.delete(left, first)

    def advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for every lane: next states and added tokens."""
        keys = state.astype(np.int64) << 8 | c
        slot = self._slots(keys)
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new = np.unique(keys[missing]).tolist()
            made = [self._compile(k >> 8, k & 255) for k in new]
            self._insert(new, [m[0] for m in made], [m[1] for m in made])
            slot = self._slots(keys)
        return self.to[slot], self.adds[slot]

    # -- word starts -----------------------------------------------------------------------------------
    def counts(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Tokens of every row of a ragged array of UTF-8 bytes."""
        if self.used > KEPT:
            self.start_over()
        n = len(limits) - 1
        total = np.zeros(n, np.int64)
        if not len(data):
            return total
        raw = data.tobytes()
        cuts, extra = limits[:-1], None
        if any(s in raw for s in self.special):
            # special strings are tokens of their own and end the text before them
            edges, skip = [], np.zeros(len(data), bool)
            for m in regex.finditer(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), raw):
                row = int(np.searchsorted(limits, m.start(), side="right")) - 1
                if m.end() <= limits[row + 1]:
                    edges += [m.start(), m.end()]
                    skip[m.start():m.end()] = True
                    total[row] += 1
            extra = skip
            cuts = np.unique(np.concatenate([limits[:-1], np.array(edges, np.int64)]))
        starts = word_starts(data, np.unique(cuts[cuts < len(data)]))
        if extra is not None:
            kept = np.flatnonzero(~extra)
            moved = np.concatenate([[0], np.cumsum(~extra)])
            data, starts, limits = data[kept], starts[kept], moved[limits]
            if not len(data):
                return total
        own = self._scan(data, starts)
        sums = np.concatenate([[0], np.cumsum(own)])
        # every row begins with a word start, so its tokens are those between its limits
        return total + sums[limits[1:]] - sums[limits[:-1]]

    def _scan(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens added at every byte."""
        size = len(data)
        added = np.zeros(size, np.int8)
        begin = np.arange(0, size, CHUNK)
        end = np.minimum(begin + CHUNK, size)
        # a chunk's map: its head ends at its first word start; from there the result does not depend on the entry
        at = np.flatnonzero(starts)
        k = np.searchsorted(at, begin)
        head = np.where(k < len(at), at[np.minimum(k, len(at) - 1)], size)
        constant = head < end
        exit_state = self._run(data, starts, added, np.where(constant, head, end), end, np.zeros(len(begin), np.int32))
        # prefix scan over the maps: for every chunk the nearest constant map at or before it
        source = np.where(constant, np.arange(len(begin)), -1)
        span = 1
        while span < len(source):
            source[span:] = np.where(source[span:] >= 0, source[span:], source[:-span])
            span *= 2
        # the bytes after a constant map up to the next word start continue its state
        last = np.unique(source)
        follow = np.append(head[last[1:]], size)
        lo, hi = end[last], np.maximum(end[last], np.minimum(follow, size))
        self._run(data, starts, added, lo, hi, exit_state[last])
        return added

    def _run(self, data, starts, added, lo, hi, state) -> np.ndarray:
        """Run lanes over [lo, hi) from their states; a word start resets a lane. Returns the last states."""
        order = np.argsort(-(hi - lo), kind="stable")
        out = state.copy()
        length = (hi - lo)[order]
        n = int((length > 0).sum())
        lanes, at, now = order[:n], lo[order[:n]].copy(), state[order[:n]].copy()
        step = 0
        while n:
            now = np.where(starts[at], 0, now)
            now, more = self.advance(now, data[at])
            added[at] = more
            at += 1
            step += 1
            alive = int(np.searchsorted(-length[:n], -step, side="left"))
            if alive < n:
                out[lanes[alive:]] = now[alive:]
                lanes, at, now, n = lanes[:alive], at[:alive], now[:alive], alive
        return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, by code point."""
    t = np.zeros(0x110000, np.uint8)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for lo in range(0, 0x110000, 0x8000):
            block = "".join(map(chr, range(lo, lo + 0x8000))) if not 0xD800 <= lo < 0xE000 else "\x00" * 0x800 + "".join(map(chr, range(0xE000, lo + 0x8000)))
            shift = lo if not 0xD800 <= lo < 0xE000 else 0xD800
            for m in regex.finditer(pattern, block):
                t[shift + m.start():shift + m.end()] = value
    return t


def word_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """True at bytes where a word of the byte-level rule starts; ``cuts`` are places where a text begins.

    The rule: a contraction, or letters, numbers or other characters with an optional space before them, or
    white space, whose last character stays for the next word if that is one.
    """
    first = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[first].astype(np.int32)
    point = b.copy()
    wide = np.flatnonzero(b >= 0x80)
    if len(wide):
        lead, at = b[wide], first[wide]
        tail = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F
        t1, t2, t3 = tail(1), tail(2), tail(3)
        made = np.where(lead < 0xE0, (lead & 0x1F) << 6 | t1, (lead & 0x0F) << 12 | t1 << 6 | t2)
        point[wide] = np.where(lead >= 0xF0, np.minimum((lead & 0x07) << 18 | t1 << 12 | t2 << 6 | t3, 0x10FFFF), made)
    n = len(point)
    kind = _classes()[point]
    begin = np.zeros(n + 1, bool)
    begin[np.searchsorted(first, cuts)] = True
    begin[n] = True
    text_start, text_end = begin[:n], begin[1:]
    space = kind == 3
    before = np.concatenate([[9], kind[:-1]])
    before = np.where(text_start, 9, before)
    after = np.where(text_end, 9, np.concatenate([kind[1:], [9]]))
    blank_before = np.concatenate([[False], point[:-1] == 32]) & ~text_start
    start = text_start | (kind != before)
    # a plain space before other characters belongs to their word
    start &= ~(blank_before & ~space)
    # the last of several white spaces before a word is on its own
    start |= space & (before == 3) & (after != 3) & (after != 9)
    # contractions
    mark = (point == 39) & start
    at = np.flatnonzero(mark)
    if len(at):
        whose = np.cumsum(text_start)
        def char(k):
            i = np.minimum(at + k, n - 1)
            return np.where((at + k < n) & (whose[i] == whose[at]), point[i], -1)
        c1, c2 = char(1), char(2)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        both = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(both, 3, np.where(one, 2, 0))
        for length in (2, 3):
            own = at[size == length]
            start[own + 1] = False
            if length == 3:
                start[own + 2] = False
            nxt = own + length
            nxt = nxt[nxt < n]
            # a space after it still joins the next word, which starts at the space anyway
            start[nxt] = True
    out = np.zeros(len(data), bool)
    out[first[start]] = True
    return out


@lru_cache(maxsize=1)
def transducer(raw: bytes) -> Transducer:
    return Transducer(raw)


def token_counts(docs: DataFrame, raw: bytes, key: str = "doc_id", text: str = "text", over: int = OVER) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; null and empty texts have none. The tokenizer's file (1.6 MB) travels with the tasks."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    schema = StructType([rows.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches):
        own = transducer(sent.value)
        for batch in batches:
            data, limits = common.buffers(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in common.row_blocks(limits, 2 << 20):
                tokens[a:b] = own.counts(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(limits), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > over, pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)


def op8_token_counts(spark, folder: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path(MODEL), "rb") as f:
        raw = f.read()
    return token_counts(common.table(spark, folder, "documents"), raw)
