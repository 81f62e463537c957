"""Quality rules as a short-circuit cascade.

Every rule is a cheap or dear condition on a text. Their cost (seconds of one aggregation over a sample) and
selectivity (share of the sample that they reject) are estimated first; the cascade then asks the rules in the
order of rejections per cost, and a text that one rule rejects is not looked at by the later ones. The order
changes the work only: the verdict is that no rule rejects, whatever the order.

Everything is built-in functions. Repeated 8-word windows are found inside the row: word hashes are folded
to hashes of 2, 4 and 8 words, and only rows with an equal pair are sorted.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut_lineage

from . import common

SPACE_CHARS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 2000


def _words(text: Column) -> Column:
    parts = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    return F.when(F.element_at(parts, 1) == "", F.array().cast("array<string>")).otherwise(parts)


def _pairs(h: Column, apart: int) -> Column:
    """Hash of every element with the one ``apart`` places later; the result is that much shorter."""
    n = F.size(h) - apart
    return F.when(n > 0, F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, apart + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(
        F.array().cast("array<bigint>"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row; null text counts as empty."""
    t = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), common.text_or_empty(text).alias("text"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     "))) > 0)
    rows = rows.select("*", F.size(_words(t)).cast("long").alias("n_words"), F.transform(_words(t), lambda w: F.xxhash64(w)).alias("h1"), lines.alias("lines"))
    rows = rows.withColumn("h2", _pairs(F.col("h1"), 1)).withColumn("h4", _pairs(F.col("h2"), 2)).withColumn("h8", _pairs(F.col("h4"), 4))
    # windows in the order of their hashes, only where two are equal
    order = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), order))
    s = F.col("s")
    twice = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.withColumn("at", F.array_sort(F.filter(twice, lambda i: i.isNotNull())))
    # union of the windows [i, i + 8): each adds what lies beyond the end so far
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("at", start, lambda a, i: F.struct((a["n"] + (i + WINDOW) - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return rows.select(
        "doc_id", "text", "n_words", F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """The method's own rules, over the columns of ``measured``; true rejects."""
    t, words, chars = F.col("text"), F.col("n_words"), F.col("word_chars")
    return {
        "shouting": 10 * (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))) > 6 * chars,
        "few_letters": 10 * F.length(F.regexp_replace(t, "\\P{L}+", "")) < 6 * chars,
        "symbols": 10 * F.col("n_symbols") > words,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (chars < 2 * words) | (chars > 12 * words),
    }


def ordered_rules(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on a sample of about ``sample_rows`` rows (hash of the key).

    The sample decides the order only. Equal figures fall back to the name.
    """
    total = rows.count()
    share = min(1.0, sample_rows / max(1, total))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = cut_lineage(measured(rows.where(draw < share)))
    base = _base_failed()
    figures = []
    sample.agg(F.count(F.lit(1))).collect()
    for name, rule in rules().items():
        start = time.perf_counter()
        n, rejected = sample.where(~base).agg(F.count(F.lit(1)), F.sum(rule.cast("int"))).first()
        cost = max(time.perf_counter() - start, 1e-4)
        figures.append((-(rejected or 0) / max(1, n) / cost, name))
    return [name for _, name in sorted(figures)]


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cascade(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row.

    Null texts count as empty; texts without a word fail the base rules (fewer than 20 words).
    """
    names = ordered_rules(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    own = rules()
    rejected = F.when(_base_failed(), True)
    for name in names:
        rejected = rejected.when(own[name], True)
    rows = measured(docs, key, text)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"),
                       (~rejected.otherwise(False)).alias("kept"))


def op5_quality_cascade(spark, folder: str) -> DataFrame:
    return cascade(common.table(spark, folder, "documents"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(text, chr(10)), lambda x: length(trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) > 0) as lines from d),
win as (
  select r, i, array_to_string(words[i:i + 7], ' ') as k from w, unnest(range(1, greatest(len(words) - 6, 1))) as u(i)),
twice as (
  select r, i, count(*) over (partition by r, k) as c from win),
cov as (
  select r, count(distinct i + j) as n from twice, range(0, 8) as v(j) where c > 1 group by r),
m as (
  select doc_id, text, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from w left join cov using (r)),
f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         10 * length(regexp_replace(text, '\P{Lu}', '', 'g')) > 6 * word_chars
         or 10 * length(regexp_replace(text, '\P{L}', '', 'g')) < 6 * word_chars
         or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 12 * n_words as ruled from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ruled as kept from f
"""
