"""Mixing sources to target weights with Pareto order sampling.

Each source gets a target in words. With r = target / size of the source, every document of the source is
wanted about r times: floor(r) certain whole copies, and one more with an inclusion probability of its own,

    p_i = p + d * (m - s_i) / max(m, s_max - m),   p = r - floor(r),   d = TILT * min(p, 1 - p),

where s_i are the document's words, s_max the most of its source and m the mean of s weighted by s. Shorter documents
are likelier, so the mix holds more different ones, and the expected words are the target still: sum s_i (m - s_i) = 0.
Every document draws a uniform u_i and gets the Pareto rank

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)),

and the documents of smallest rank are taken until the rest of the target is filled; the document that
crosses the limit is taken if that comes nearer to the target.

Draws are functions of id, text, source and a number among rows equal in these, so reruns agree, rows without an id are drawn one by one,
and repeated rows differ.

Scale: a source may hold a third of all rows, so no task orders a whole source. Documents are counted into
``BUCKETS`` rank buckets per source (folded before the shuffle), the sums show the one bucket in which the
limit falls, and only that bucket's documents are ordered. The result is one limit per source. Sources themselves are
ordered by windows that see one row per source.

Defined cases: a null text has no words; null is a source of its own; a source without words has target 0; an empty table has no rows;
other columns are ignored (by ``stage``: kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut_lineage, has_at_most, salted_join

from . import common

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
TILT = 0.5
BUCKETS = 4096
#: Rows of the per-source table that are broadcast; above that it is joined with salt.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    """Words of a text; a null text has none."""
    parts = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    return F.when(text.isNull() | (F.element_at(parts, 1) == ""), 0).otherwise(F.size(parts)).cast("long")


def row_key(doc_id: Column, text: Column, source: Column) -> Column:
    """Equal for rows equal in id, text and source."""
    of = lambda c: F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("-"))
    return F.md5(F.concat_ws(":", of(doc_id), of(text), of(source)))


def uniform(key: Column, turn: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of a row's key and its number among equal rows."""
    digest = F.md5(F.concat(F.lit("mix:"), key, F.lit(":"), turn.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def draws(rows: DataFrame, key: str = "_key") -> DataFrame:
    """Adds ``_u``. Rows of equal key are numbered first, over many tasks; keys that occur once need no numbers."""
    once = uniform(F.col(key), F.lit(0))
    repeated = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if repeated.isEmpty():
        return rows.withColumn("_u", once)
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    single = salted_join(placed, repeated, key, "_place", how="left_anti").drop("_place").withColumn("_u", once)
    packed = salted_join(placed, repeated, key, "_place").drop("_place").select(key, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    many = common.numbered(packed, key, [], "mix")
    return single.unionByName(many.withColumn("_u", uniform(F.col(key), F.col("pos"))).select("_row.*", "_u"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, total and target: shares of SHARE * all words by weight, none above MOST * its own words.

    The excess of capped sources is shared by weight among the others until none is above. With sources in
    the order of MOST * total / weight, the first ones are the capped ones, so one pass over running sums
    finds the level at which the rest is served. The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("total") * MOST).withColumn("full", F.col("cap") / F.col("weight"))
    line = Window.orderBy("full", F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("all_words", F.sum("total").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", (F.col("all_words") * SHARE - F.col("capped")) / (F.col("all_weight") - F.col("used"))))
    # the first source in this order that its share does not fill is the first one without a cap
    rows = rows.withColumn("place", F.row_number().over(line)).withColumn("open", F.min(F.when(F.col("level") <= F.col("full"), F.col("place"))).over(everything))
    level = F.max(F.when(F.col("place") == F.col("open"), F.col("level"))).over(everything)
    return rows.withColumn("at", level).select("source", "total", F.least("cap", F.coalesce(F.col("weight") * F.col("at"), F.col("cap"))).alias("target"))


def pareto_rank(u: Column, size: Column) -> Column:
    """q of a document from its draw, its size and its source's p, d, mean and spread; null where no further copy is drawn."""
    p = F.col("p") + F.col("d") * (F.col("mean") - size) / F.col("spread")
    return F.when((F.col("p") > 0) & (F.col("p") < 1), (u / (1 - u)) / (p / (1 - p)))


def plan(sized: DataFrame) -> DataFrame:
    """One row per source: _source, total, target, copies (certain), p, d, mean, spread and last_q, the largest rank that is taken.

    ``sized``: source, size, _u.
    """
    exact = F.col("size").cast("decimal(18,0)")
    sums = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("total"), F.sum(exact * exact).cast("double").alias("squares"), F.max("size").alias("longest")))
    per_source = targets(sums.select("source", "total")).join(sums.select(F.col("source").alias("_s"), "squares", "longest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    r = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    per_source = per_source.withColumn("r", r).withColumn("copies", F.floor("r")).withColumn("p", F.col("r") - F.col("copies"))
    per_source = (per_source.withColumn("rest", F.col("target") - F.col("copies") * F.col("total")).withColumn("d", TILT * F.least("p", 1 - F.col("p")))
                  .withColumn("mean", F.when(F.col("total") > 0, F.col("squares") / F.col("total")).otherwise(1.0)).withColumn("spread", F.greatest("mean", F.col("longest") - F.col("mean"))))
    per_source = cut_lineage(per_source.select(F.col("source").alias("_source"), "total", "target", "copies", "p", "d", "mean", "spread", "rest"))
    ranked = attach(sized, per_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("q", pareto_rank(F.col("_u"), F.col("size"))).where("q is not null")
    ranked = ranked.select("_source", "rest", "size", "q", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).alias("bucket"))
    counted = ranked.groupBy("_source", "rest", "bucket").agg(F.sum("size").alias("words"))
    sums = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("_source").orderBy("bucket")))
    # the first bucket at whose end the rest is reached
    limit = cut_lineage(sums.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
                        .select(F.col("_source").alias("_l"), F.col("bucket").alias("_b"), (F.col("upto") - F.col("words")).alias("start")))
    inside = attach(ranked.withColumnRenamed("q", "_u"), limit, F.col("_source").eqNullSafe(F.col("_l")) & (F.col("bucket") == F.col("_b")), "inner").withColumnRenamed("_u", "q")
    peers = inside.groupBy("_source", "rest", "start", "q").agg(F.sum("size").alias("size"))
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("_source").orderBy("q"))
    taken = peers.withColumn("upto", upto).where(F.col("upto") + F.col("upto") - F.col("size") < 2 * F.col("rest"))
    # where the first document inside crosses the limit and stays out, all buckets before are taken
    last = limit.join(taken.groupBy(F.col("_source").alias("_t")).agg(F.max("q").alias("q")), F.col("_l").eqNullSafe(F.col("_t")), "left")
    last = last.select("_l", F.col("q").alias("last_q"), F.col("_b").alias("below"))
    return cut_lineage(per_source.join(last, F.col("_source").eqNullSafe(F.col("_l")), "left").drop("_l", "rest"))


def copies(u: Column, size: Column) -> Column:
    """Copies of a document that carries its source's plan."""
    q = pareto_rank(u, size)
    more = F.coalesce((q <= F.col("last_q")) | (F.floor(q / (1 + q) * BUCKETS) < F.col("below")), F.lit(False))
    return F.coalesce(F.col("copies"), F.lit(0)).cast("int") + more.cast("int")


def attach(docs: DataFrame, small: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a table with one row per source: broadcast behind a check of its rows, with salt beyond it."""
    if has_at_most(small, BROADCAST_SOURCES):
        return docs.join(F.broadcast(small), on, how)
    salts = 64
    left = docs.withColumn("_salt_l", F.pmod(F.xxhash64("_u"), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on & (F.col("_salt_l") == F.col("_salt_r")), how).drop("_salt_l", "_salt_r")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0, 1 or 2) of every row."""
    sized = docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), words_in(F.col(text)).alias("size"), row_key(F.col(key), F.col(text), F.col(source)).alias("_key"))
    sized = cut_lineage(draws(cut_lineage(sized)).drop("_key"))
    out = attach(sized, plan(sized.select("source", "size", "_u")), F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", copies(F.col("_u"), F.col("size")).alias("copies"))


def op9_pareto_mixing(spark, folder: str) -> DataFrame:
    out = mix(common.table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) as size,
         md5(coalesce(md5(doc_id::varchar), '-') || ':' || coalesce(md5(text), '-') || ':' || coalesce(md5(source), '-')) as key from documents),
drawn as (
  select *, (('0x' || substr(md5('mix:' || key || ':' || (row_number() over (partition by key) - 1)::varchar), 1, 13))::bigint::double + 0.5) / {float(1 << 52)} as u from sized),
sources as (
  select source, sum(size)::bigint as total, sum(size::hugeint * size)::double as squares, max(size) as longest from sized group by source),
weighed as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight from sources),
lined as (
  select *, total * 2.0::double as cap, total * 2.0::double / weight as full_at from weighed),
summed as (
  select *, sum(total) over () as all_words, sum(weight) over () as all_weight,
         coalesce(sum(cap) over (order by full_at, source is null, source rows between unbounded preceding and 1 preceding), 0) as capped,
         coalesce(sum(weight) over (order by full_at, source is null, source rows between unbounded preceding and 1 preceding), 0) as used
  from lined),
levelled as (
  select *, (all_words * 1.5::double - capped) / (all_weight - used) as level,
         row_number() over (order by full_at, source is null, source) as place from summed),
opened as (
  select *, min(case when level <= full_at then place end) over () as open from levelled),
planned as (
  select *, least(cap, coalesce(weight * (max(case when place = open then level end) over ()), cap)) as target from opened),
rated as (
  select *, case when total > 0 then target / total else 0 end as r, case when total > 0 then squares / total else 1 end as mean from planned),
tilted as (
  select *, r - floor(r) as p, target - floor(r) * total as rest, {TILT}::double * least(r - floor(r), 1 - (r - floor(r))) as d, greatest(mean, longest - mean) as spread from rated),
chances as (
  select s.doc_id, s.source, s.size, s.u, t.total, t.target, t.r, t.p, t.rest, t.p + t.d * (t.mean - s.size) / t.spread as own
  from drawn s join tilted t on s.source is not distinct from t.source),
ranked as (
  select *, (u / (1 - u)) / (own / (1 - own)) as q from chances),
placed as (
  select *, sum(size) over (partition by source order by q) as upto, sum(size) over (partition by source, q) as peers from ranked)
select doc_id, size::bigint as size, total as source_size, target,
       (size * (floor(r) + case when p > 0 and 2 * upto - peers < 2 * rest then 1 else 0 end))::bigint as taken
from placed
"""


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: every document as many times as the mix takes it; rows of a source without any word are not taken."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = draws(docs.select(own, row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("_key")))
    rows = rows.select("_doc", F.col("_doc.source").alias("source"), words_in(F.col("_doc.text")).alias("size"), "_u")
    # the plan needs the sizes only; texts are read again when the mix is written
    sized = cut_lineage(rows.select("source", "size", "_u"))
    out = attach(rows, plan(sized), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_n", copies(F.col("_u"), F.col("size")))
    return out.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*")
