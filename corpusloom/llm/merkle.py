"""Merkle manifest of a dataset, with levels kept as concatenated strings.

A leaf is the SHA-256 (lowercase hex) of a row's fields. The leaves of a group stand in the order of their key;
every ``RUN`` consecutive nodes become the hash of their concatenated digests until one is left, the group's
subroot. The subroots, ordered by group, become the root in the same way.

The nodes of a group are cut into aligned blocks of ``RUN ** DEPTH``. A block keeps each of its levels as one hex
string: the next level hashes fixed-width substrings of it, and the siblings of a node are the substrings that
flank it inside its run. As blocks are aligned and a power of the run, a block ends in one node, and the nodes
of all blocks form the same problem again, ``RUN ** DEPTH`` times smaller; roots recurse until one block is left.

Scale: texts are hashed where they are read and never shuffled. Keys are numbered by range partitions and
offsets, so a group of a third of all rows spreads; a block is at most 256 leaves. Rounds grow with the logarithm
of the largest group. Each round's blocks are a table in the shared checkpoint folder.

Defined cases: null fields count as ``-``; rows of equal or null keys (null first) stand in the order of their
leaves; a group of one row has its leaf as subroot; an empty table has no rows and no root; columns other than the five
named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import common

RUN = 2
DEPTH = 8
HEX = 64
SEGMENTS = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """Hash of the fields, each as its UTF-8 length, a colon and its text, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parents(level: Column, run: int) -> Column:
    """The next level of a level string: the hashes of its fixed-width substrings."""
    runs = F.ceil(F.length(level) / (run * HEX)).cast("int")
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (run * HEX) + 1, F.lit(run * HEX)), 256)))


def flanks(levels: Column, place: Column, run: int) -> Column:
    """Per level below the last: the substrings left and right of the node above ``place`` inside its run."""
    def at(level, j):
        node = F.floor(place / F.pow(F.lit(run), j)).cast("int")
        first = (F.floor(node / run) * run).cast("int")
        return F.struct(F.substring(level, first * HEX + 1, (node - first) * HEX).alias("left"),
                        F.substring(level, node * HEX + HEX + 1, (first + (run - 1) - node) * HEX).alias("right"))
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), at)


def rounds(nodes: DataFrame, run: int, depth: int, name: str) -> list[DataFrame]:
    """Tables of blocks: g, block, total, items (in order) and levels; each round's nodes are the last round's block ends.

    ``nodes``: g, pos, total, node, item.
    """
    out, size = [], run ** depth
    while True:
        place = F.struct((F.col("pos") % size).cast("int").alias("place"), "node", "item")
        blocks = nodes.groupBy("g", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(place)).alias("items"))
        height = reduce(lambda a, b: a + b, [(F.lit(run ** j) < F.col("total")).cast("int") for j in range(depth)])
        steps = F.slice(F.array(*[F.lit(j) for j in range(depth)]), 1, height)
        start = F.array(F.concat_ws("", F.col("items.node")))
        levels = F.aggregate(steps, start, lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1), run))))
        blocks = common.stored(blocks.select("g", "block", "total", F.col("items.item").alias("items"), levels.alias("levels")), f"{name}-{len(out)}")
        out.append(blocks)
        open_ = blocks.where(F.col("total") > size)
        if open_.isEmpty():
            return out
        nodes = open_.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"),
                             F.element_at("levels", -1).alias("node"), F.lit(None).cast(blocks.schema["items"].dataType.elementType).alias("item"))


def ends(tables: list[DataFrame], size: int) -> DataFrame:
    """g and node: the one node that is left of every group."""
    done = [t.where(F.col("total") <= size).select("g", F.element_at("levels", -1).alias("node")) for t in tables]
    return reduce(DataFrame.unionByName, done)


def descend(tables: list[DataFrame], tops: DataFrame, run: int, depth: int) -> DataFrame:
    """item, segments and top of every first node: its siblings level by level, then those of its group's end.

    ``tops``: g, segments and top (any value that goes down unchanged) of every group.
    """
    size, above = run ** depth, None
    for table in reversed(tables):
        done = table.where(F.col("total") <= size).select("g", F.col("block").alias("_b"))
        paths = done.join(tops.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "_b", "segments", "top")
        if above is not None:
            paths = paths.unionByName(above.select("g", F.col("pos").alias("_b"), "segments", "top"))
        paths = paths.select(F.col("g").alias("_g"), "_b", F.col("segments").alias("_up"), "top")
        rows = table.join(paths, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
        rows = rows.select("g", "block", "levels", "_up", "top", F.posexplode("items").alias("place", "item"))
        above = rows.select("g", (F.col("block") * size + F.col("place")).alias("pos"), "item", "top", F.concat(flanks(F.col("levels"), F.col("place"), run), F.col("_up")).alias("segments"))
    return above


def fold(start: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(segments, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None, n_chars_changed: Column | None = None, run: int = RUN, depth: int = DEPTH,
             key: str = "doc_id", group: str = "lang") -> DataFrame:
    """key, group, leaf, subroot, root, segments (left and right siblings up to the root), proof_sha256, folded_root, verified.

    ``changed`` marks rows whose leaf is computed anew with ``n_chars_changed`` before folding, as if someone had
    altered them after the manifest was made; the other rows fold their own leaf.
    """
    fields = lambda n: leaf(F.col(key), F.col("source"), F.col(group), n, F.col("text"))
    other = F.when(changed, fields(n_chars_changed)) if changed is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("_key"), F.col(group).alias("g"), fields(F.col("n_chars")).alias("node"), other.alias("other"))
    placed = common.numbered(rows, "g", ["_key", "node"], "merkle")
    low = rounds(placed.select("g", "pos", "total", "node", F.struct("_key", F.col("node").alias("leaf"), "other").alias("item")), run, depth, "merkle-low")
    subroots = common.numbered(ends(low, run ** depth).select(F.lit(0).alias("all"), F.col("g").alias("name"), "node"), "all", ["name"], "merkle-groups")
    high = rounds(subroots.select(F.col("all").alias("g"), "pos", "total", "node", F.struct("name", "node").alias("item")), run, depth, "merkle-high")
    root = ends(high, run ** depth).first()
    root = F.lit(root["node"] if root else None).cast("string")
    one = docs.sparkSession.range(1).select(F.col("id").cast("int").alias("g"), F.array().cast(SEGMENTS).alias("segments"), F.lit(0).alias("top"))
    tops = descend(high, one, run, depth).select(F.col("item.name").alias("g"), "segments", F.col("item.node").alias("top"))
    out = descend(low, tops, run, depth).select(F.col("item._key").alias(key), F.col("g").alias(group), F.col("item.leaf").alias("leaf"), F.col("top").alias("subroot"),
                                               root.alias("root"), "segments", F.col("item.other").alias("_other"))
    siblings = F.concat_ws("", F.transform("segments", lambda s: F.concat(s["left"], s["right"])))
    out = out.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", fold(F.coalesce("_other", "leaf"), F.col("segments")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("_other")


def op13_merkle_manifest(spark, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest(docs, changed, F.try_add(F.col("n_chars"), F.lit(1)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
_UP = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
SQL = f"""
with recursive leaves as (
  select doc_id, lang, {_LEAF.format(n='n_chars')} as leaf,
         case when doc_id is not null and {_CRC32} % 7 = 0 then {_LEAF.format(n='(n_chars + 1)')} end as other from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves),
tree as (
  select lang, 0 as level, list(leaf order by pos) as nodes from placed group by lang
  union all
  select lang, level + 1, {_UP} from tree where len(nodes) > 1),
subroots as (
  select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as pos from tree where len(nodes) = 1),
top as (
  select 0 as level, list(subroot order by pos) as nodes from subroots
  union all
  select level + 1, {_UP} from top where len(nodes) > 1),
low_siblings as (
  select p.lang, p.pos, list(case when (p.pos >> t.level) & 1 = 1 then 'L' else 'R' end || coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') order by t.level) as low
  from placed p join tree t on p.lang is not distinct from t.lang and len(t.nodes) > 1 group by all),
high_siblings as (
  select s.lang, list(case when (s.pos >> t.level) & 1 = 1 then 'L' else 'R' end || coalesce(t.nodes[xor(s.pos >> t.level, 1) + 1], '') order by t.level) as high
  from subroots s join top t on len(t.nodes) > 1 group by all),
joined as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from top where len(nodes) = 1) as root, coalesce(p.other, p.leaf) as start,
         list_concat(coalesce(l.low, []::varchar[]), coalesce(h.high, []::varchar[])) as siblings
  from placed p join subroots s on p.lang is not distinct from s.lang
  left join low_siblings l on p.lang is not distinct from l.lang and p.pos = l.pos left join high_siblings h on p.lang is not distinct from h.lang),
folded as (
  select *, sha256(array_to_string(list_transform(siblings, lambda s: substr(s, 2)), '')) as proof_sha256,
         list_reduce(list_prepend(start, siblings), lambda a, s: sha256(case when s[1] = 'L' then substr(s, 2) || a else a || substr(s, 2) end)) as folded_root from joined)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""
