"""SimHash near-duplicates found by pigeonring filtering.

Fingerprints: 3-word shingles (repeats included) are hashed with XXH64; a bit is set if it is set in over
half of the hashes. Two fingerprints link if at most ``DISTANCE`` bits differ.

Candidates: the 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most t bits,
then some place on the ring starts a chain of segments in which, for every length l, the first l segments
differ in at most t * l / m bits. With t = 2 and m = 7 the first three segments of that chain must be equal
(27 or 28 bits); these are the join key, one row per starting place. Inside a key the longer prefixes of
the chain prune pairs before the whole distance is counted. No link is lost: the principle is an
equivalence for the full chain.

Scale: equal fingerprints are folded first, so copies cost nothing. Groups of one key are cut into blocks
of at most ``BLOCK`` fingerprints and compared block against block, and every comparison returns a spanning
forest, never all pairs. Keys that hold more than ``HOT`` fingerprints are split again before that, by the
same principle on the bits the key leaves open: of any three parts of those bits, one must be equal.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.topics import components as components_of
from corpusloom.session import cut_lineage, salted_join

from . import common

DISTANCE = 2
SEGMENTS = 7
HOT = 2048
BLOCK = 1024
SEED = 42
#: Bits of each segment: the ring starts at the highest bit.
LIMITS = tuple(round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1))
#: Segments that must be equal at the start of a chain: the longest l with t * l / m < 1.
EQUAL = math.ceil(SEGMENTS / DISTANCE) - 1


def fingerprint(text: bytes) -> int:
    """Of one lower-cased text as UTF-8; 0 if it has no word."""
    words = text.split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[a:a + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (long). bytes.split() cuts at the six ASCII spaces, which is the word rule of this operator."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            prints = []
            data, limits = common.buffers(batch.column(1))
            raw = data.tobytes()
            for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
                prints.append(fingerprint(raw[a:b].lower()))  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fp: Column, a: int, b: int) -> Column:
    """Bits a to b, counted from the highest, as a number."""
    return F.shiftrightunsigned(fp, 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _ring_key(fp: Column, start: int) -> Column:
    """The first EQUAL segments of the chain that starts at a segment, as one number."""
    out = F.lit(0).cast("long")
    for j in range(EQUAL):
        s = (start + j) % SEGMENTS
        out = F.shiftleft(out, LIMITS[s + 1] - LIMITS[s]).bitwiseOR(_bits(fp, LIMITS[s], LIMITS[s + 1]))
    return out


def _open_bits(start: int) -> list[int]:
    closed = {(start + j) % SEGMENTS for j in range(EQUAL)}
    return [b for s in range(SEGMENTS) if s not in closed for b in range(LIMITS[s], LIMITS[s + 1])]


def _split_key(fp: Column, start: Column, part: int) -> Column:
    """Part 0, 1 or 2 of the bits that the key of ``start`` leaves open."""
    out = F.lit(None).cast("long")
    for s in range(SEGMENTS):
        bits = _open_bits(s)
        third = [bits[i * len(bits) // 3:(i + 1) * len(bits) // 3] for i in range(3)][part]
        mask = 0
        for b in third:
            mask |= 1 << (63 - b)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out = F.when(start == s, fp.bitwiseAND(F.lit(mask).cast("long"))).otherwise(out)
    return out


def _chain(diff: np.ndarray, distance: int = DISTANCE, limits: tuple[int, ...] = LIMITS) -> np.ndarray:
    """True where some start on the ring has every prefix of its chain within its share of the budget."""
    counts, segments = [], len(limits) - 1
    for s in range(segments):
        mask = np.uint64(((1 << (limits[s + 1] - limits[s])) - 1) << (64 - limits[s + 1]))
        counts.append(np.bitwise_count(diff & mask))
    found = np.zeros(diff.shape, bool)
    for s in range(segments):
        ok, sofar = np.ones(diff.shape, bool), np.zeros(diff.shape, np.uint8)
        for l in range(1, segments + 1):
            sofar = sofar + counts[(s + l - 1) % segments]
            ok &= sofar.astype(np.int64) * segments <= distance * l
        found |= ok
    return found


def _forest(a: np.ndarray, b: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two arrays of fingerprints (or inside one, if they are equal)."""
    nodes = np.unique(np.concatenate([a, b]))
    root = np.arange(len(nodes))
    edges = []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seg = (start + EQUAL) % SEGMENTS
    mask = np.uint64(((1 << (LIMITS[seg + 1] - LIMITS[seg])) - 1) << (64 - LIMITS[seg + 1]))
    at_a, at_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    for lo in range(0, len(a), 256):
        diff = a[lo:lo + 256, None] ^ b[None, :]
        # the next prefix of this chain allows one differing bit; then the whole chain, then the distance
        i, j = np.nonzero(np.bitwise_count(diff & mask) <= DISTANCE * (EQUAL + 1) // SEGMENTS)
        d = diff[i, j]
        ok = (d != 0) & _chain(d)
        ok[ok] = np.bitwise_count(d[ok]) <= DISTANCE
        for x, y in zip(at_a[lo + i[ok]].tolist(), at_b[j[ok]].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((int(nodes[x]), int(nodes[y])))
    return edges


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a spanning forest of every block; ``prints`` has a column fp, each once."""
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), _ring_key(F.col("fp"), s).alias("key"))
                                                     for s in range(SEGMENTS)])).alias("k")).select("fp", "k.*")
    keyed = keyed.withColumn("part", F.lit(-1)).withColumn("rest", F.lit(0).cast("long"))
    sizes = keyed.groupBy("start", "key").count()
    hot = cut_lineage(sizes.where(F.col("count") > HOT))
    if hot.limit(1).count():
        big = keyed.join(hot.drop("count"), ["start", "key"])
        cool = keyed.join(hot.drop("count"), ["start", "key"], "left_anti")
        again = big.select("fp", "start", "key", F.explode(F.array(*[
            F.struct(F.lit(p).alias("part"), _split_key(F.col("fp"), F.col("start"), p).alias("rest")) for p in range(3)])).alias("k")).select("fp", "start", "key", "k.*")
        keyed = cool.select("fp", "start", "key", "part", "rest").unionByName(again)
    group = ["start", "key", "part", "rest"]
    sizes = keyed.groupBy(*group).count().where("count > 1")
    sized = keyed.join(sizes, group)
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # block i is compared with every block j >= i: a row goes to the pairs that hold its block
    other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt = sized.select("fp", *group, own.alias("own"), F.explode(other).alias("p")).select("fp", *group, "own", "p.i", "p.j")

    def run(key, batch):
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        own = np.asarray(batch.column("own"))
        i, j = key[5].as_py(), key[6].as_py()
        edges = _forest(fp, fp, key[0].as_py()) if i == j else _forest(fp[own == i], fp[own == j], key[0].as_py())
        e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    few = dealt.withColumn("z", F.lit(0))
    return few.groupBy(*group, "z", "i", "j").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """fp, component: the smallest ``least`` among the fingerprints reachable over ``edges``; null only if all are.

    ``rank`` has one row (fp, least) per fingerprint. The parts are found by fingerprints, which are never null: every
    round gives each node the smallest fingerprint of itself, its neighbours and the nodes these point at; rounds are
    written to the checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    touched = cut_lineage(both)
    if not touched.limit(1).count():
        return rank.select("fp", F.col("least").alias("component"))
    label = cut_lineage(touched.select(F.col("a").alias("fp")).distinct().withColumn("part", F.col("fp")))
    while True:
        near = touched.join(label.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("part").alias("near"))
        joined = label.join(near, "fp").select("fp", "part", F.least("part", "near").alias("new"))
        # pointer jumping: take over the label of the fingerprint that names the new label
        owner = label.select(F.col("fp").alias("new"), F.col("part").alias("far"))
        moved = cut_lineage(joined.join(owner, "new").select("fp", "part", F.least("new", "far").alias("new")))
        changed = moved.where("new <> part").limit(1).count()
        label = moved.select("fp", F.col("new").alias("part"))
        if not changed:
            break
    names = label.join(rank, "fp").groupBy("part").agg(F.min("least").alias("component"))
    named = salted_join(label, names, "part", "fp").select("fp", "component", F.lit(True).alias("linked"))
    return rank.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id of every row.

    Null text counts as empty; texts without a word have fingerprint 0 and are linked like any other. Rows
    with a null id take part but cannot name a component: a component of such rows only has a null id.
    """
    prints = cut_lineage(fingerprints(docs, key, text))
    rank = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = components(links(rank.select("fp")), rank)
    # a fingerprint of a third of all rows meets its one row in many tasks
    salts = 64
    left = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["fp", "_salt"]).select("doc_id", "fp", F.col("component").alias("component_id"))


def op6_simhash_near_duplicates(spark, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- pipeline stage: similarity of 0.8 over five-word shingles ------------------------------------------
SHINGLE = 5
SIMILAR = 0.8
#: Fingerprints of samples that a text has, and the shingles of a sample.
SAMPLES = 10
SAMPLED = 3
#: Texts before it that a text of a sample is compared with first, and texts of a sample that one window holds.
BEFORE = 2
GROUP = 1000
#: Texts of a sample that one block holds when the pairs left over are compared.
MOST = 200
#: At a similarity of 0.8 two fingerprints differ in 9.7 bits on average with a deviation of 2.9; this is four deviations more.
WIDE = 22
WIDE_LIMITS = tuple(range(0, 65, 2))
_FACTORS = tuple(int(x) | 1 for x in np.random.default_rng(SEED).integers(1, 2 ** 63, SAMPLES, dtype=np.int64))


def shingle_hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of the five-word shingles of a lower-cased text; of a shorter one its whole sequence; none of a text without a word."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < SHINGLE else [b" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def _simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sample_prints(docs: DataFrame, text: str = "text") -> DataFrame:
    """t (md5 of the text), fp (fingerprint of all shingles), size (their number) and keys (fingerprints of ``SAMPLES`` consistent samples) of each distinct text.

    A sample holds the ``SAMPLED`` shingles that come first in an order of its own, so texts of similarity s share a sample with a
    probability of about s ** ``SAMPLED`` each: at 0.8 all but 0.1 % of the pairs share one.
    """
    rows = docs.select(common.text_or_empty(text).alias("text")).select(F.md5("text").alias("t"), "text")

    def run(batches):
        for batch in batches:
            data, limits = common.buffers(batch.column(1))
            whole, sizes, keys = [], [], []
            for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
                h = shingle_hashes(data[a:b].tobytes().lower())
                whole.append(_simhash(h))
                sizes.append(len(h))
                with np.errstate(over="ignore"):
                    orders = [(h * np.uint64(f)) for f in _FACTORS]
                keys.append([_simhash(h[np.argpartition(o, SAMPLED)[:SAMPLED]] if len(h) > SAMPLED else h) for o in orders])
            keys = np.array(keys, np.uint64).reshape(-1, SAMPLES).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SAMPLES), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists],
                                             names=["t", "fp", "size", "keys"])

    return (rows.mapInArrow(run, "t string, fp long, size long, keys array<long>").groupBy("t")
            .agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))


def _places(table: pa.Table):
    """The rows of each place of a bucket, one table at a time."""
    table = table.combine_chunks().sort_by("place")
    names = np.asarray(table.column("place").to_numpy(zero_copy_only=False), object)
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
    return [table.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _open_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one block: those of the left, those of the right, and which of their pairs may be similar and are not connected."""
    right = np.asarray(rows.column("other"), bool)
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    part = rows.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    fp, size = np.asarray(rows.column("fp")).view(np.uint64), np.asarray(rows.column("size"))
    few, many = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    # no similarity is greater than the share of the sizes
    found = (part[left][:, None] != part[right][None, :]) & (few >= SIMILAR * many)
    x, y = np.nonzero(found)
    diff = fp[left[x]] ^ fp[right[y]]
    found[x, y] = np.bitwise_count(diff) <= WIDE
    x, y = np.nonzero(found)
    found[x, y] = _chain(fp[left[x]] ^ fp[right[y]], WIDE, WIDE_LIMITS)
    return left, right, found


def other_links(docs: DataFrame, sampled: DataFrame, links: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links that pairs of one sample add to ``links``, as a spanning forest of every block.

    What ``links`` connect needs no comparison. In a sample the texts outside its largest part meet all texts of other parts, block by block, so nothing
    is left out and a sample that is one part costs nothing. Shingles go only to blocks where their text has a pair that sizes and fingerprints allow.
    """
    member = components_of(links).select(F.col("node").alias("t"), "component")
    rows = common.stored(sampled.join(member, "t", "left").select("place", "t", "fp", "size", F.coalesce("component", "t").alias("part")), "simhash-parts")
    count = rows.groupBy("place", "part").agg(F.count("*").alias("c")).groupBy("place").agg(F.sum("c").alias("n"), F.max(F.struct("c", "part")).alias("top"))
    open_ = cut_lineage(count.where((F.col("n") > BEFORE + 1) & (F.col("top.c") < F.col("n")))
                        .select("place", "n", (F.col("n") - F.col("top.c")).alias("m"), F.col("top.part").alias("main")))
    small = F.col("n") <= MOST
    buckets = max(1, -(-(open_.agg(F.sum(F.when(small, F.col("n")))).first()[0] or 0) // (2 * MOST)))
    open_ = open_.select("place", "main", F.ceil(F.col("n") / MOST).cast("int").alias("ni"), F.ceil(F.col("m") / MOST).cast("int").alias("nj"),
                         F.when(small, F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("string")).otherwise(F.col("place")).alias("bucket"))
    rows = common.join_hot(rows, open_, "place", F.col("t"))
    i, j = (F.pmod(F.xxhash64("t"), F.col(c)).cast("int") for c in ("ni", "nj"))
    kept = ["bucket", "place", "t", "fp", "size", "part"]
    dealt = (rows.select(*kept, F.lit(False).alias("other"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
             .unionByName(rows.where("part <> main").select(*kept, F.lit(True).alias("other"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), j.alias("j"))))
    grid = ["bucket", "i", "j"]

    def meeting(table):
        out = [table.slice(0, 0)]
        for own in _places(table):
            left, right, found = _open_pairs(own)
            out.append(own.take(np.sort(np.concatenate([left[found.any(1)], right[found.any(0)]]))))
        return pa.concat_tables(out)

    met = common.stored(dealt.groupBy(*grid).applyInArrow(meeting, dealt.schema), "simhash-open")
    texts = (docs.select(common.text_or_empty(text).alias("text")).select(F.md5("text").alias("t"), "text")
             .join(met.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text")))

    def hashed(batches):
        for batch in batches:
            data, limits = common.buffers(batch.column(1))
            rows = [shingle_hashes(data[a:b].tobytes().lower()) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["t", "shingles"])

    shingles = common.stored(texts.mapInArrow(hashed, "t string, shingles array<long>"), "simhash-shingles")

    def verify(table):
        links = []
        for own in _places(table):
            left, right, found = _open_pairs(own)
            ids = own.column("t").to_pylist()
            root = own.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).copy()
            lists = own.column("shingles").combine_chunks()
            limits = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            names, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            marked = np.zeros(len(names), bool)
            for k, y in enumerate(right.tolist()):
                near = left[found[:, k]]
                near = near[root[near] != root[y]]
                if not len(near):
                    continue
                mine = code[limits[y]:limits[y + 1]]
                marked[mine] = True
                size = limits[near + 1] - limits[near]
                ends = np.cumsum(size)
                at = np.repeat(limits[near] - (ends - size), size) + np.arange(ends[-1])
                shared = np.add.reduceat(marked[code[at]].astype(np.int64), ends - size)
                marked[mine] = False
                for x in near[shared >= SIMILAR * (size + len(mine) - shared)].tolist():
                    if root[x] != root[y]:
                        root[root == root[x]] = root[y]
                        links.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.string()), "b": pa.array([y for _, y in links], pa.string())})

    return met.join(shingles, "t").groupBy(*grid).applyInArrow(verify, "a string, b string").distinct()


def similar_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links between hashes of different texts whose sets of five-word shingles have a similarity of ``SIMILAR`` or more.

    Texts with an equal sample fingerprint are compared first with the smallest text of that sample and with the ``BEFORE`` texts before them, which
    connects most copies; then with all texts of the sample that are not connected to them yet (``other_links``). The pigeonring chain on the whole
    fingerprints, with the wide budget, prunes pairs before their shingles are counted.
    """
    prints = common.stored(sample_prints(docs, text), "simhash-samples")
    places = prints.select("t", "fp", "size", F.posexplode("keys").alias("sample", "key")).withColumn("place", F.concat_ws(":", "sample", "key")).select("t", "fp", "size", "place")
    sampled = places.drop("size")
    first = cut_lineage(sampled.groupBy("place").agg(F.min(F.struct("t", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1"))
    met = common.join_hot(sampled, first.select("place", "n", F.col("c.t").alias("first"), F.col("c.fp").alias("first_fp")), "place", F.col("t"))
    # a large sample is cut by a hash of the text, so no window holds more than about GROUP texts
    line = Window.partitionBy("place", F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / GROUP))).orderBy("t")
    others = [F.struct(F.col("first").alias("b"), F.col("first_fp").alias("fb"))] + [F.struct(F.lag("t", k).over(line).alias("b"), F.lag("fp", k).over(line).alias("fb")) for k in range(1, BEFORE + 1)]
    met = met.select(F.col("t").alias("a"), "fp", F.array(*others).alias("others"))
    pairs = met.select("a", "fp", F.explode("others").alias("o")).select("a", "fp", "o.*").where("b < a").distinct()

    def near(batches):
        for batch in batches:
            diff = np.asarray(batch.column("fp")).view(np.uint64) ^ np.asarray(batch.column("fb")).view(np.uint64)
            keep = _chain(diff, WIDE, WIDE_LIMITS)
            keep[keep] = np.bitwise_count(diff[keep]) <= WIDE
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = common.stored(pairs.mapInArrow(near, "a string, b string"), "simhash-pairs")
    wanted = pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))).distinct()
    texts = docs.select(common.text_or_empty(text).alias("text")).select(F.md5("text").alias("t"), "text").join(wanted, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    texts = common.stored(texts, "simhash-texts", "snappy")
    both = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("x")), "a")
    both = common.join_hot(both, texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b", F.col("a")).select("a", "b", "x", "y")

    def verify(batches):
        # the first text of a sample meets many others
        first = lru_cache(maxsize=16)(lambda text: shingle_hashes(text.lower()))
        for batch in batches:
            (xs, x_limits), (ys, y_limits) = (common.buffers(batch.column(c)) for c in ("x", "y"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = shingle_hashes(xs[x_limits[i]:x_limits[i + 1]].tobytes().lower()), first(ys[y_limits[i]:y_limits[i + 1]].tobytes())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = shared >= SIMILAR * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    links = common.stored(both.mapInArrow(verify, "a string, b string"), "simhash-links")
    return links.unionByName(other_links(docs, places, links, text))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates only one row stays, the first by doc_id (nulls last) and hash of the text.

    Near-duplicates are texts with a similarity of ``SIMILAR`` or more over five-word shingles (see ``similar_texts``), and what links of such
    texts connect; documents without a word are one group. Rows that repeat a doc_id with different texts are judged each in its own group.
    """
    hashed = F.md5(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), hashed.alias("t"))
    ranked = cut_lineage(docs.select(row.alias("r")).groupBy(F.col("r.t").alias("t")).agg(F.min("r").alias("r")))
    member = cut_lineage(components_of(similar_texts(docs)))
    named = ranked.join(member.withColumnRenamed("node", "t"), "t", "left").select(F.coalesce("component", "t").alias("part"), "r")
    first = named.groupBy("part").agg(F.min("r").alias("r")).select("r.*")
    copies = docs.select("doc_id", hashed.alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("_nd_rows"))
    keep = first.select(F.col("d").alias("_nd_id"), F.col("t").alias("_nd_text"))
    keep = cut_lineage(keep.join(copies, keep["_nd_id"].eqNullSafe(copies["doc_id"]) & (keep["_nd_text"] == copies["t"])).select("_nd_id", "_nd_text", "_nd_rows"))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_nd_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == keep["_nd_text"]))
    out = kept.where("_nd_rows = 1").select(*[docs[f"`{c}`"] for c in docs.columns])
    if keep.where("_nd_rows > 1").limit(1).count():
        row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
        once = kept.where("_nd_rows > 1").groupBy("_nd_id", "_nd_text").agg(F.min_by(row, F.md5(F.to_json(row))).alias("_nd_row"))
        out = out.unionByName(once.select("_nd_row.*"))
    return out
