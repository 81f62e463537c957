"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places in the shards.

Files of a store (all numbers little-endian):

``ids-NNNNN.bin``    ids of consecutive documents in ascending key order, nothing else; 2 bytes an id where the
                     vocabulary allows it, else 4. Each document ends with the end id.
``index-NNNNN.bin``  ``FILE_BUCKETS`` buckets of the index: a directory of byte places (u64, one more than buckets), then per bucket its
                     pilots (u32) and its slots (``SLOT``: fingerprint, shard, offset and length in ids).
``manifest.json``    bytes per id, end id, number of buckets, documents and first id of every shard.

Index: a key's first hash names its bucket and, inside, a group of about four keys; the group's pilot, mixed into the
second hash, sends each key to a slot of its own. Pilots are searched when the bucket is built, largest groups first, until
the n keys of a bucket fill exactly n slots. A lookup reads one directory entry, one pilot and one slot, whatever the size; the
stored fingerprint tells a key that is not in the store (false once in 2 ** 32). As rows may repeat a key, the hashed key is
(key, turn): turn counts the rows of equal key from 0 in the order of the files.

Words are encoded by the tokenizers library once per task and then remembered, as its byte-level pre-tokenizer never lets
a token cross words; other tokenizers encode whole texts.

Scale: texts are shuffled once, by ranges of (key, hash of the text, place read), so a key that a third of the rows share spreads over
many shards. A task streams its range into one file under a name of its own and renames it when whole, so lost or repeated
tasks leave whole files only. Keys are dealt to index buckets by hash and read back by shard. The driver sees one row per shard.

Defined cases: a null text is empty, so its document is the end id; null keys come first; rows of equal key stand in the order of the
text's hash; an empty table is a store without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.session import scratch_folder

from . import common
from .token_counts import word_starts

MODEL = "byte_bpe_50k.json"
END = 2
BUCKET_KEYS = 1024
FILE_BUCKETS = 128
GROUP_KEYS = 4
PILOTS = 512
#: Words that a worker remembers; beyond it the memory starts anew.
KEPT = 800_000
READ = 4 << 20
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u4")])


# -- files ---------------------------------------------------------------------------------------------
def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share (a path, or a URI that pyarrow knows)."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class Whole:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = opened(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.own = f"{base}/{name}", f"{base}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
        self.sink = self.fs.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.sink.write(data)

    def close(self) -> None:
        self.sink.close()
        try:
            self.fs.move(self.own, self.path)
        except OSError:
            # another attempt of this task was first; its file is the same
            if self.fs.get_file_info(self.path).type != pa.fs.FileType.File:
                raise
            self.fs.delete_file(self.own)


def _ids_name(shard: int) -> str:
    return f"ids-{shard:05d}.bin"


def _index_name(part: int) -> str:
    return f"index-{part:05d}.bin"


# -- encoding ------------------------------------------------------------------------------------------
class _Numbers(dict):
    """Numbers of words in the order in which they are first met; ``fresh`` holds those that nobody has taken up yet."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """The tokenizers library with remembered words."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(raw)
        pre = spec.get("pre_tokenizer") or {}
        self.lib = Tokenizer.from_str(raw.decode())
        self.by_word = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
        special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile(b"|".join(map(regex.escape, special))) if special else None
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.slots = _Numbers()
        self.ids, self.limits = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        ids = [e.ids for e in self.lib.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum(sizes)])

    def encode(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row of a ragged array of UTF-8 bytes, and their limits."""
        if not self.by_word:
            texts = [data[a:b].tobytes().decode() for a, b in zip(limits[:-1], limits[1:])]
            ids = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(limits), np.int64)
        raw, edges = data.tobytes(), []
        for m in self.special.finditer(raw) if self.special else ():
            row = int(np.searchsorted(limits, m.start(), side="right")) - 1
            if m.end() <= limits[row + 1]:
                edges.append(m.span())
        cuts = np.unique(np.concatenate([limits[:-1], np.array(edges, np.int64).reshape(-1)]))
        starts = word_starts(data, cuts[cuts < len(data)])
        for a, b in edges:
            starts[a + 1:b] = False
        at = np.flatnonzero(starts)
        places = [*at.tolist(), len(raw)]
        words = [raw[a:b] for a, b in zip(places, places[1:])]
        if len(self.slots) > KEPT:
            self._forget()
        codes = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if self.slots.fresh:
            self._learn(self.slots.fresh)
            self.slots.fresh = []
        ids, ends = common.gather_ragged(self.ids, self.limits, codes)
        return ids, ends[np.searchsorted(at, limits)]


@lru_cache(maxsize=1)
def encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


# -- minimal perfect hash ------------------------------------------------------------------------------
def hashes(key: Column, turn: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key and its turn."""
    name = F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")), F.lit("#"), turn.cast("string"))
    return F.xxhash64(name), F.xxhash64(F.concat(F.lit("2"), name))


def hashes_of(key, turn: int) -> np.ndarray:
    """The same for one key outside Spark."""
    name = ("-" if key is None else f"={key}") + f"#{turn}"
    return np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in (name, "2" + name)], np.uint64).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _groups(h1: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h1) % np.uint64(-(-n // GROUP_KEYS))).astype(np.int64)


def _place(h2: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h2.astype(np.uint64) ^ _mix(pilot.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def _fingerprint(h1: np.ndarray) -> np.ndarray:
    return (h1.astype(np.uint64) >> np.uint64(32)).astype("<u4")


def find_pilots(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the groups of one bucket, and the slot of every key: a permutation of 0..n-1."""
    n = len(h1)
    group = _groups(h1, n)
    pilots, slot, free = np.zeros(-(-n // GROUP_KEYS), np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(len(pilots) + 1))
    for g in np.argsort(-np.diff(first), kind="stable"):
        keys = order[first[g]:first[g + 1]]
        if not len(keys):
            break
        for start in range(0, 1 << 24, PILOTS):
            places = _place(h2[keys][:, None], np.arange(start, start + PILOTS)[None, :], n)
            good = free[places].all(0)
            if len(keys) > 1:
                good &= (np.diff(np.sort(places, axis=0), axis=0) > 0).all(0)
            if good.any():
                p = int(good.argmax())
                break
        else:
            raise ValueError("two keys with equal hashes")
        pilots[g], slot[keys] = start + p, places[:, p]
        free[slot[keys]] = False
    return pilots, slot


def index_file(bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """The file of ``FILE_BUCKETS`` buckets; ``bucket`` counts from the file's first one."""
    order = np.argsort(bucket, kind="stable")
    limits = np.searchsorted(bucket[order], np.arange(FILE_BUCKETS + 1))
    blobs = []
    for a, b in zip(limits[:-1], limits[1:]):
        own = order[a:b]
        if not len(own):
            blobs.append(b"")
            continue
        pilots, slot = find_pilots(h1[own], h2[own])
        slots = np.zeros(len(own), SLOT)
        slots["fingerprint"][slot], slots["shard"][slot], slots["offset"][slot], slots["length"][slot] = _fingerprint(h1[own]), shard[own], offset[own], length[own]
        blobs.append(pilots.astype("<u4").tobytes() + slots.tobytes())
    places = 8 * (FILE_BUCKETS + 1) + np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
    return places.astype("<u8").tobytes() + b"".join(blobs)


def keys_of_bucket(size: int) -> int:
    """Number of keys whose pilots and slots take ``size`` bytes."""
    n = 4 * size // (4 * SLOT.itemsize + 4)
    while n * SLOT.itemsize + 4 * -(-n // GROUP_KEYS) > size:
        n -= 1
    return n


def look_up(index: bytes | memoryview, bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of keys in one index file, and whether the fingerprint agrees."""
    places = np.frombuffer(index, "<u8", FILE_BUCKETS + 1).astype(np.int64)
    out, found = np.zeros(len(bucket), SLOT), np.zeros(len(bucket), bool)
    for b in np.unique(bucket):
        n = keys_of_bucket(int(places[b + 1] - places[b]))
        if not n:
            continue
        own, groups = np.flatnonzero(bucket == b), -(-n // GROUP_KEYS)
        pilots = np.frombuffer(index, "<u4", groups, int(places[b]))
        slots = np.frombuffer(index, SLOT, n, int(places[b]) + 4 * groups)
        out[own] = slots[_place(h2[own], pilots[_groups(h1[own], n)], n)]
        found[own] = out["fingerprint"][own] == _fingerprint(h1[own])
    return out, found


# -- store ---------------------------------------------------------------------------------------------
def write_store(docs: DataFrame, folder: str, raw: bytes, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a store and return its keys: key, turn."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(raw)
    rows = docs.select(F.col(key).alias("key"), common.text_or_empty(text).alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    line = [F.col(c).asc_nulls_first() for c in ("key", "_h", "_tie")]
    rows = rows.repartitionByRange(*line).sortWithinPartitions(*line).select("key", "text")
    schema = StructType([StructField("shard", LongType()), rows.schema["key"], *[StructField(c, LongType()) for c in ("turn", "offset", "length")]])

    def run(batches):
        from pyspark import TaskContext
        own, shard, file, offset = encoder(sent.value), TaskContext.get().partitionId(), None, 0
        last, turn = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file = file or Whole(folder, _ids_name(shard))
            _, limits = common.buffers(batch.column(1))
            for a, b in common.row_blocks(limits, 2 << 20):
                data, inner = common.buffers(batch.column(1).slice(a, b - a))
                ids, ends = own.encode(data, inner)
                ids = np.insert(ids, ends[1:], end)
                file.write(ids.astype(f"<u{own.width}").tobytes())
                lengths = np.diff(ends) + 1
                turns = []
                for k in batch.column(0).slice(a, b - a).to_pylist():
                    turn = turn + 1 if (k,) == last else 0
                    last = (k,)
                    turns.append(turn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard), pa.int64()), batch.column(0).slice(a, b - a), pa.array(turns, pa.int64()),
                                                  pa.array(offset + np.cumsum(lengths) - lengths, pa.int64()), pa.array(lengths, pa.int64())], names=schema.names)
                offset += int(lengths.sum())
        if file:
            file.close()

    placed = common.stored(rows.mapInArrow(run, schema), "token-store-places")
    shards = (placed.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("length").alias("ids"), F.min_by("key", "offset").alias("first"),
                                          F.max_by("key", "offset").alias("last"), F.max_by("turn", "offset").alias("turn")).orderBy("shard").collect())
    start, starts, before, moved = 0, {}, ((None,), 0), []
    for s in shards:
        starts[s["shard"]], start = start, start + s["ids"]
        more = before[1] if before[0] == (s["first"], "key") else 0
        if more:
            moved.append((s["shard"], more))
        before = ((s["last"], "key"), s["turn"] + 1 + (more if s["first"] == s["last"] else 0))
    if moved:
        # one row per shard at most: keys that run on from the shard before
        firsts = F.broadcast(spark.createDataFrame(moved, "shard long, _more long").join(placed.groupBy("shard").agg(F.min_by("key", "offset").alias("_first")), "shard"))
        placed = placed.join(firsts, "shard", "left").withColumn("turn", F.col("turn") + F.when(F.col("_more").isNotNull() & F.col("key").eqNullSafe(F.col("_first")), F.col("_more")).otherwise(0)).drop("_more", "_first")
    total = sum(s["docs"] for s in shards)
    buckets = max(1, -(-total // BUCKET_KEYS))
    h1, h2 = hashes(F.col("key"), F.col("turn"))
    keyed = placed.withColumn("h1", h1).withColumn("h2", h2).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    keyed = keyed.withColumn("part", F.floor(F.col("bucket") / FILE_BUCKETS).cast("long"))

    def build(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        col = lambda c: np.asarray(rows.column(c).combine_chunks())
        file = Whole(folder, _index_name(part))
        file.write(index_file(col("bucket") - part * FILE_BUCKETS, col("h1"), col("h2"), col("shard"), col("offset"), col("length")))
        file.close()
        return pa.table({"part": pa.array([part], pa.int64()), "keys": pa.array([rows.num_rows], pa.int64())})

    indexed = keyed.select("part", "bucket", "h1", "h2", "shard", "offset", "length").groupBy("part").applyInArrow(build, "part long, keys long")
    if (indexed.agg(F.sum("keys")).first()[0] or 0) != total:
        raise RuntimeError("the index has not all keys")
    head = {"format": 1, "width": encoder(raw).width, "end": end, "docs": total, "ids": start, "buckets": buckets,
            "shards": [{"shard": s["shard"], "docs": s["docs"], "start": starts[s["shard"]], "ids": s["ids"]} for s in shards]}
    file = Whole(folder, "manifest.json")
    file.write(json.dumps(head).encode())
    file.close()
    return placed.select(F.col("key").alias(key), "turn")


def read_manifest(folder: str) -> dict:
    fs, base = opened(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


class Store:
    """Keyed access to single documents: three small ranged reads in the index and one in a shard."""

    def __init__(self, folder: str):
        self.head = read_manifest(folder)
        self.fs, self.base = opened(folder)

    def _read(self, name: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(size, at)

    def get(self, key, turn: int = 0) -> np.ndarray | None:
        """Ids of a document with its end id, or None."""
        h = hashes_of(key, turn)
        part, b = divmod(int(h[0]) % self.head["buckets"], FILE_BUCKETS)
        name = _index_name(part)
        if self.fs.get_file_info(f"{self.base}/{name}").type != pa.fs.FileType.File:
            return None
        at, end = np.frombuffer(self._read(name, 8 * b, 16), "<u8").tolist()
        n = keys_of_bucket(end - at)
        if not n:
            return None
        pilot = np.frombuffer(self._read(name, at + 4 * int(_groups(h[:1], n)[0]), 4), "<u4")
        place = int(_place(h[1:], pilot, n)[0])
        slot = np.frombuffer(self._read(name, at + 4 * -(-n // GROUP_KEYS) + place * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        if slot["fingerprint"] != _fingerprint(h[:1])[0]:
            return None
        width = self.head["width"]
        return np.frombuffer(self._read(_ids_name(int(slot["shard"])), width * int(slot["offset"]), width * int(slot["length"])), f"<u{width}")


def read_documents(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id", turn: str = "turn") -> DataFrame:
    """key, turn, found, start (ids before it in the store) and ids (little-endian u32, with the end id) of the asked documents.

    Keys are looked up in the index file of their hash and then read from their shard in the order of the file; keys that
    the store does not have come back with found = false.
    """
    head = read_manifest(folder)
    width, starts = head["width"], {s["shard"]: s["start"] for s in head["shards"]}
    h1, h2 = hashes(F.col("key"), F.col("turn"))
    asked = keys.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn")).withColumn("h1", h1).withColumn("h2", h2)
    asked = asked.withColumn("bucket", F.pmod("h1", F.lit(head["buckets"]))).withColumn("part", F.floor(F.col("bucket") / FILE_BUCKETS).cast("long"))
    places = StructType([asked.schema["key"], *[StructField(c, LongType()) for c in ("turn", "shard", "offset", "length")]])

    def locate(batches):
        fs, base = opened(folder)
        now, index = None, b""
        for batch in batches:
            part, bucket, a, b = (np.asarray(batch.column(c)) for c in ("part", "bucket", "h1", "h2"))
            slots, found = np.zeros(batch.num_rows, SLOT), np.zeros(batch.num_rows, bool)
            for p in np.unique(part):
                if p != now:
                    path = f"{base}/{_index_name(int(p))}"
                    now, index = p, b"\0" * (8 * (FILE_BUCKETS + 1))
                    if fs.get_file_info(path).type == pa.fs.FileType.File:
                        with fs.open_input_stream(path) as f:
                            index = f.read()
                own = np.flatnonzero(part == p)
                slots[own], found[own] = look_up(index, bucket[own] - int(p) * FILE_BUCKETS, a[own], b[own])
            column = lambda c: pa.array(slots[c].astype(np.int64), pa.int64(), mask=~found)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("turn"), column("shard"), column("offset"), column("length")], names=places.names)

    located = common.stored(asked.repartition("part").sortWithinPartitions("part").mapInArrow(locate, places), "token-store-located")
    missing = located.where(F.col("shard").isNull()).select("key", "turn", F.lit(False).alias("found"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("binary").alias("ids"))
    present = located.where(F.col("shard").isNotNull()).repartition("shard").sortWithinPartitions("shard", "offset")
    schema = missing.schema

    def read(batches):
        fs, base = opened(folder)
        now, file = None, None
        for batch in batches:
            shard, offset, length = (np.asarray(batch.column(c)) for c in ("shard", "offset", "length"))
            i = 0
            while i < len(shard):
                # one read for documents of a shard that follow each other closely
                j = i + 1
                while j < len(shard) and shard[j] == shard[i] and (offset[j] + length[j] - offset[i]) * width <= READ:
                    j += 1
                if shard[i] != now:
                    if file:
                        file.close()
                    now, file = shard[i], fs.open_input_file(f"{base}/{_ids_name(int(shard[i]))}")
                first, last = int(offset[i]), int((offset[i:j] + length[i:j]).max())
                ids = np.frombuffer(file.read_at((last - first) * width, first * width), f"<u{width}").astype("<u4")
                blobs = [ids[a - first:a - first + n].tobytes() for a, n in zip(offset[i:j].tolist(), length[i:j].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), batch.column("turn").slice(i, j - i), pa.array([True] * (j - i), pa.bool_()),
                                                  pa.array(starts[int(now)] + offset[i:j], pa.int64()), pa.array(blobs, pa.binary())], names=schema.names)
                i = j
        if file:
            file.close()

    out = present.mapInArrow(read, schema).unionByName(missing)
    return out.withColumnRenamed("key", key).withColumnRenamed("turn", turn)


def op11_token_store(spark, folder: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path(MODEL), "rb") as f:
        raw = f.read()
    store = scratch_folder(spark, "token-store")
    keys = write_store(common.table(spark, folder, "documents"), store, raw)
    got = read_documents(spark, store, keys)
    return got.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
