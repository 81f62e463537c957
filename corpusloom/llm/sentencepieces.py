"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton runs over the characters once. At every position the output links list all pieces that end
there, longest first, and the best score of the position is relaxed over them; the way back gives the ids.

Unigram models: the score of a path is the sum of its pieces' scores. Merge (BPE) models: their scores are
merge priorities, and the path of the greatest sum is not what the library returns. There an arc may follow
another only if merging would not have joined across their border, which leaves exactly one path into every
position: the library's own. Whether a piece may follow another is found by undoing the merges of both and
is kept for every pair seen.

Pieces never hold a space sign after another character (checked when a model is read), so texts are encoded
in segments of spaces and following characters, and a worker encodes a distinct segment once. Models are read
from the public file format, never trained; unknown characters become byte pieces.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Distinct segments that a worker remembers; beyond it only those stay that were used again, half of them at most.
KEPT_SEGMENTS = 150_000
#: Moves over fail links and answers whether a piece may follow another that a worker remembers; beyond it that memory starts anew.
KEPT_MOVES = 600_000
#: Piece types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) pairs of one protocol buffer message."""
    at, end = 0, len(raw)

    def varint(at):
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at
    while at < end:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The model of one file: pieces, automaton, encoding and decoding."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.merges, dummy, squeeze = False, True, True
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and merge models")
                self.merges = kind == 2
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map are not supported")
                dummy, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if USER_DEFINED in self.types:
            raise ValueError("user-defined pieces are not supported")
        self.dummy, self.squeeze = dummy, squeeze
        self.worst = min(self.scores, default=0.0) - 10.0   # score of an unknown character
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        usable = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable):
            raise ValueError("a piece holds a space sign after another character")
        self.letters = {}           # characters of pieces that are no pieces themselves
        for p in list(usable):
            for c in p:
                if c not in usable:
                    self.letters[c] = usable[c] = len(self.pieces) + len(self.letters)
        self.names = self.pieces + list(self.letters)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        if self.merges:
            usable = self._reachable(usable)
        self._automaton(usable)
        self.follows: dict[int, bool] = {}
        self.table = [self._bytes_of(i) for i in range(len(self.pieces))]
        # a segment's number is its place in the memory; limits of its ids in flat, and how often texts had it
        self.memory: dict[str, int] = {}
        self.flat, self.limits, self.uses = array("i"), array("q", [0]), np.zeros(0, np.int64)

    # -- merges ---------------------------------------------------------------------------------------
    def _rank(self, i: int) -> float:
        return -self.scores[i] if i < len(self.scores) else float("inf")

    def _reachable(self, usable: dict[str, int]) -> dict[str, int]:
        """Pieces that merging their own characters gives back, with the last merge of each."""
        kept = {p: i for p, i in usable.items() if len(p) == 1}
        for p, i in usable.items():
            if len(p) == 1:
                continue
            parts, last = list(p), None
            while len(parts) > 1:
                best = None
                for k in range(len(parts) - 1):
                    j = usable.get(parts[k] + parts[k + 1])
                    if j is not None and (best is None or self._rank(j) < best[0]):
                        best = (self._rank(j), k)
                if best is None:
                    break
                k = best[1]
                last = (parts[k], parts[k + 1])
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                kept[p] = i
                self.parts[i] = (usable[last[0]], usable[last[1]])
        self.order = {i: self._rank(i) for p, i in kept.items() if len(p) > 1}
        self.known = kept
        return kept

    def _may_follow(self, a: int, b: int) -> bool:
        """True if merging the characters of a and b leaves both whole.

        Walks back in time along the border: the later of the two merges is undone first. A piece that spans
        the border and was possible before the pieces at the border were themselves merged refutes the pair.
        """
        rank, names = self.order, self.names
        limit = (float("inf"), 1)
        while True:
            joint = self.known.get(names[a] + names[b])
            if joint is not None:
                # of equal ranks the left merge comes first, and the joint piece starts left of b, not of a
                if (rank[joint], 1) < limit:
                    return False
            ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = (ra, 0), self.parts[a][1]
            elif rb > ra:
                limit, b = (rb, 2), self.parts[b][0]
            else:
                # the same merge on both sides: the left one comes first, so the right one is undone first
                limit, b = (rb, 2), self.parts[b][0]

    # -- automaton ------------------------------------------------------------------------------------
    def _automaton(self, usable: dict[str, int]) -> None:
        """Trie as one dict (node << 21 | character); fail and output links of every node."""
        step, piece, depth = {}, [-1], [0]
        for p, i in usable.items():
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                    depth.append(depth[node] + 1)
                node = step[key]
            piece[node] = i
        fail, link = [0] * len(piece), [0] * len(piece)
        for key, node in sorted(step.items(), key=lambda x: depth[x[1]]):
            parent, c = key >> 21, key & 0x1FFFFF
            if parent:
                f = fail[parent]
                while f and f << 21 | c not in step:
                    f = fail[f]
                fail[node] = step.get(f << 21 | c, 0)
            # the next shorter piece that ends here
            link[node] = fail[node] if piece[fail[node]] >= 0 else link[fail[node]]
        self.step, self.fail = step, fail
        # pieces that end at a node, by its output links, longest first
        self.ends: list[tuple] = [()] * len(piece)
        for node in sorted(range(1, len(piece)), key=depth.__getitem__):
            own = ((piece[node], depth[node]),) if piece[node] >= 0 else ()
            self.ends[node] = own + self.ends[link[node]]
        self.moves = dict(step)     # with the moves over fail links that texts have needed

    def _move(self, node: int, c: int) -> int:
        at = node
        while at and at << 21 | c not in self.step:
            at = self.fail[at]
        to = self.moves[node << 21 | c] = self.step.get(at << 21 | c, 0)
        return to

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of one segment (space signs, then other characters)."""
        moves, ends, merges, follows, width = self.moves, self.ends, self.merges, self.follows, len(self.names) + 1
        n = len(segment)
        last, best = [-1] * (n + 1), [0.0] * (n + 1)
        node = i = 0
        for c in map(ord, segment):
            i += 1
            to = moves.get(node << 21 | c)
            node = self._move(node, c) if to is None else to
            if merges:
                for p, size in ends[node]:
                    before = last[i - size]
                    if before < 0:
                        ok = True
                    else:
                        ok = follows.get(before * width + p)
                        if ok is None:
                            ok = follows[before * width + p] = self._may_follow(before, p)
                    if ok:
                        last[i] = p
                        break
            else:
                top, choice = best[i - 1] + self.worst, -1
                for p, size in ends[node]:
                    s = best[i - size] + self.scores[p]
                    if s > top:
                        top, choice = s, p
                best[i], last[i] = top, choice
        out, i = [], n
        while i:
            p = last[i]
            if 0 <= p < len(self.pieces):
                out.append(p)
                i -= len(self.pieces[p])
            else:
                raw = segment[i - 1].encode("utf-8", "surrogatepass")
                out.extend([self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown])
                i -= 1
        out.reverse()
        return out

    # -- texts ----------------------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return []
        # a plain space stands for the space sign until a segment is encoded
        return re.findall(" *[^ ]+| +", (" " if self.dummy else "") + text.replace(SPACE, " "))

    def _forget(self) -> None:
        """Keeps the segments used most, at most half of ``KEPT_SEGMENTS`` and none that was used once; older uses count half."""
        kept = np.flatnonzero(self.uses > 1)
        kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:KEPT_SEGMENTS // 2]])
        flat, limits = common.gather_ragged(np.array(self.flat, np.int32), np.array(self.limits, np.int64), kept)
        names = list(self.memory)
        self.memory = {names[k]: n for n, k in enumerate(kept.tolist())}
        self.flat, self.limits, self.uses = array("i", flat.tobytes()), array("q", limits.tobytes()), self.uses[kept] // 2

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the limits of each text."""
        if len(self.memory) > KEPT_SEGMENTS:
            self._forget()
        if len(self.moves) - len(self.step) + len(self.follows) > KEPT_MOVES:
            self.moves, self.follows = dict(self.step), {}
        memory, wanted, counts = self.memory, array("q"), []
        for text in texts:
            own = self.segments(text)
            for s in own:
                k = memory.get(s)
                if k is None:
                    k = memory[s] = len(self.limits) - 1
                    self.flat.extend(self.segment_ids(s.replace(" ", SPACE)))
                    self.limits.append(len(self.flat))
                wanted.append(k)
            counts.append(len(own))
        flat, limits = np.array(self.flat, np.int32), np.array(self.limits, np.int64)
        wanted = np.frombuffer(wanted, np.int64) if len(wanted) else np.zeros(0, np.int64)
        uses = np.bincount(wanted, minlength=len(memory))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        ids, ends = common.gather_ragged(flat, limits, wanted)
        return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.table.__getitem__, ids))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(raw: bytes) -> Pieces:
    return Pieces(raw)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, raw: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, n_tokens and round_trip (the ids decode to the text) of every row.

    Null and empty texts have no ids. A text that holds the space sign U+2581 itself cannot come back
    exactly: the format reads it as a space. The model travels with the task (its file, 0.5 MB).
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])

    def run(batches):
        own = model(raw)
        for batch in batches:
            limits = common.buffers(batch.column(1))[1]
            for a, b in common.row_blocks(limits, 1 << 20):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, ends = own.encode_all(texts)
                back = [own.decode(ids[s:e].tolist()) == t for s, e, t in zip(ends[:-1], ends[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array(np.diff(ends), pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, raw: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text; null ids give a null text."""
    rows = coded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        own = model(raw)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("text", StringType())]))


def default_model() -> bytes:
    import public_tokenizers
    return read_model(public_tokenizers.path(MODEL))


def op4_sentencepiece(spark, folder: str) -> DataFrame:
    return encode(common.table(spark, folder, "documents"), default_model())


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Last pipeline stage: ids of every row that the mix kept."""
    return encode(docs, default_model())
