"""Token store, phrase mining and Merkle manifest against brute force, with nulls, repeated rows, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, merkle, phrases, registry, token_store
from corpusloom.session import scratch_folder

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, g long, pos long, node string, turn long, gid long, block long, words string, h1 long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "k", 1, 2, "n", 3, 4, 5, "w", 6) for i, t, l, s in rows], DOCS)


LONG = " ".join(f"word{i % 997} and more" for i in range(4000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "a", "en", None), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
        (None, "some text without an id", None, "b"), (None, "some text without an id", None, "b"), (None, "another text", "en", "b"), (6, "x" * 30000, "en", "a"),
        (7, "123 456 !!", "de", "c"), (8, "Ünï çödé 漢字 😀 text<|endoftext|>end", "fr", "c"), (9, "some text without an id", "en", "c"), (-3, "I'm 'here'  <|endoftext", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS)


# -- 11 ------------------------------------------------------------------------------------------------
RAW = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()


def _library_ids(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_str(RAW.decode())
    return [[*e.ids, 2] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_is_the_library():
    r = random.Random(4)
    alphabet = ["a", "b", "the ", " ", "  ", "\n", "'s", "'", "ll", "é", "漢", "😀", "1", "23", "!", "<|endoftext|>", "<|", "\t", " ", " ", "ß", "-", "."]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", "<|endoftext|>"]
    arr = pa.array(texts)
    ids, ends = token_store.Encoder(RAW).encode(*common.buffers(arr))
    assert [[*ids[a:b].tolist(), 2] for a, b in zip(ends[:-1], ends[1:])] == _library_ids(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1024, 1200])
def test_pilots_make_a_permutation(n):
    r = np.random.default_rng(n)
    h1, h2 = r.integers(-2**63, 2**63 - 1, n), r.integers(-2**63, 2**63 - 1, n)
    pilots, slot = token_store.find_pilots(h1, h2)
    assert sorted(slot.tolist()) == list(range(n))
    assert (token_store._place(h2, pilots[token_store._groups(h1, n)], n) == slot).all()
    file = token_store.index_file(np.zeros(n, np.int64), h1, h2, np.arange(n), np.arange(n) * 7, np.arange(n) + 1)
    got, found = token_store.look_up(file, np.zeros(n, np.int64), h1, h2)
    assert found.all() and (got["shard"] == np.arange(n)).all() and (got["length"] == np.arange(n) + 1).all()
    other = r.integers(-2**63, 2**63 - 1, n)
    assert not token_store.look_up(file, np.zeros(n, np.int64), other, other)[1].any()


def test_store_keyed_access(spark, odd):
    folder = scratch_folder(spark, "store")
    keys = token_store.write_store(odd.repartition(3), folder, RAW)
    want = defaultdict(list)
    for (i, t, _, _), ids in zip(ROWS, _library_ids([t for _, t, _, _ in ROWS])):
        want[i].append(ids)
    got = defaultdict(list)
    rows = token_store.read_documents(spark, folder, keys).collect()
    assert len(rows) == len(ROWS) and all(r["found"] for r in rows)
    for r in rows:
        got[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    # ascending ids, null first; each document starts where the one before ends
    line = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in line] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i))
    assert [r["start"] for r in line] == np.cumsum([0, *[len(r["ids"]) // 4 for r in line]])[:-1].tolist()
    store = token_store.Store(folder)
    assert store.get(4).tolist() == want[4][0] and store.get(7).tolist() == want[7][0]
    assert {tuple(store.get(5, t).tolist()) for t in (0, 1)} == {tuple(x) for x in want[5]}
    assert sorted(store.get(None, t).tolist() for t in range(3)) == sorted(want[None])
    assert store.get(5, 2) is None and store.get(1234567) is None and store.get(None, 3) is None
    asked = spark.createDataFrame([(4, 0), (4, 1), (999, 0)], "doc_id long, turn long")
    assert {(r["doc_id"], r["turn"]): r["found"] for r in token_store.read_documents(spark, folder, asked).collect()} == {(4, 0): True, (4, 1): False, (999, 0): False}


def test_store_of_one_key_over_many_shards(spark):
    """A key that all rows share runs on over the borders of shards."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
        docs = docs.unionByName(spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")))
        folder = scratch_folder(spark, "store")
        keys = token_store.write_store(docs, folder, RAW)
        assert len(token_store.read_manifest(folder)["shards"]) > 2
        assert keys.distinct().count() == 700
        assert {(r[0], r[1]) for r in keys.groupBy("doc_id").agg(F.max("turn")).collect()} == {(None, 399), (5, 299)}
        rows = token_store.read_documents(spark, folder, keys).collect()
        assert len({r["start"] for r in rows}) == 700 and all(r["found"] for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_store_of_nothing(spark, odd):
    folder = scratch_folder(spark, "store")
    keys = token_store.write_store(odd.limit(0), folder, RAW)
    assert token_store.read_documents(spark, folder, keys).count() == 0
    assert token_store.Store(folder).get(1) is None


def test_op11_against_the_library(spark):
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    want, start = {}, 0
    for (i, _), ids in zip(docs, _library_ids([t for _, t in docs])):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = registry.QUERIES["op11_token_store"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


# -- 12 ------------------------------------------------------------------------------------------------
def _collocations(rows, least, longest, top, within):
    import re
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * a >= within * found[lang, words[i:i + size]]:
                    gone.add((lang, words[i:i + size]))
    out = []
    for lang in n:
        best = []
        for (la, words), a in found.items():
            if la == lang and (la, words) not in gone:
                score, k = min(((1000 * a * n[lang]) // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
                best.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def gossip(spark):
    r = random.Random(7)
    rows = list(ROWS)
    for i in range(300):
        words = [r.choice(["New", "york", "a", "a", "b", "the", "Ünï", " x", "rare%d" % i]) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            words[5:5] = ["we", "are", "here", "to", "stay", "now"]
        rows.append((100 + i, r.choice([" ", "  ", "\t"]).join(words).replace("b", "b" + r.choice(".,;\n ")), r.choice(["en", "en", "de", None]), "a"))
    return rows


@pytest.mark.parametrize("block,most,within,top", [(1 << 20, 300_000, 100, 2000), (500, 0, 100, 2000), (500, 300_000, 60, 5)])
def test_collocations(spark, gossip, block, most, within, top):
    """With broadcast groups and with joined ones, whole relations and many blocks."""
    got = phrases.collocations(frame(spark, gossip).repartition(3), least=20, within=within, top=top, block=block, most=most)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == _collocations(gossip, 20, 5, top, within)


def test_collocations_of_nothing(spark, odd):
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd, least=10**6).count() == 0


# -- 13 ------------------------------------------------------------------------------------------------
def _h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(row, more=0):
    i, text, lang, source = row
    n = None if text is None else len(text) + more
    return _h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)])


def _climb(nodes, run):
    """Root, and per node its siblings level by level as (left, right)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, places):
            first = at // run * run
            p.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + run])))
        nodes, places = [_h(*nodes[i:i + run]) for i in range(0, len(nodes), run)], [at // run for at in places]
    return nodes[0], paths


def _manifest(rows, run):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(((row[0] is not None, row[0] or 0), _leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _climb([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: x[:2])], run) for g in names}
    root, tops = _climb([trees[g][0] for g in names], run)
    out = []
    for g, top in zip(names, tops):
        for (_, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = _leaf(row, 1) if changed else leaf
            for left, right in path + top:
                node = _h(left, node, right)
            out.append((row[0], leaf, trees[g][0], root, _h(*[a + b for a, b in path + top]), node, node == root))
    return sorted(out, key=str)


CHANGED = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
SHOWN = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("run,depth,many", [(2, 8, 0), (2, 2, 150), (3, 1, 150), (2, 1, 40)])
def test_manifest(spark, run, depth, many):
    """Blocks of several sizes: one round, several rounds, and runs of three."""
    rows = ROWS + [(1000 + i, f"text {i}", "en" if i % 3 else f"l{i % 30}", "s") for i in range(many)]
    got = merkle.manifest(frame(spark, rows).repartition(3), CHANGED(), F.col("n_chars") + 1, run, depth).select(*SHOWN).collect()
    assert sorted((tuple(r) for r in got), key=str) == _manifest(rows, run)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_manifest_of_little(spark, odd):
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = merkle.manifest(frame(spark, ROWS[3:4])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["verified"]


def test_numbering_spreads_equal_rows(spark):
    """Equal rows are numbered over several parts, each number once."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select(F.lit(None).cast("string").alias("g"), F.lit(1).alias("x"))
        got = common.numbered(rows, "g", ["x"], "test")
        assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(5000))
        assert got.select("total").distinct().collect()[0][0] == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
