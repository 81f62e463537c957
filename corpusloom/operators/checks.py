"""Predicates and checks over columns, contexts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T


def documents_by_source(docs: DataFrame, part: str) -> DataFrame:
    return docs.filter(F.contains("source", F.lit(part)))


def chunks_by_score(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("score") >= least)


# Tests of one column; each is true for a valid value.

def in_range(c: str, low: float | None = None, high: float | None = None) -> Column:
    x = F.col(c).try_cast("double")
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (x >= low)
    return ok & (x <= high) if high is not None else ok


def positive(c: str, allow_zero: bool = False) -> Column:
    x = F.col(c).try_cast("double")
    return F.coalesce((x > 0) | ((x == 0) & F.lit(allow_zero)), F.lit(False))


def has_length(c: str, low: int = 0, high: int | None = None) -> Column:
    ok = F.col(c).isNotNull() & (F.length(c) >= low)
    return ok & (F.length(c) <= high) if high is not None else ok


def is_email(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(V.EMAIL), F.lit(False))


def is_url(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(V.URL), F.lit(False))


def present(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def castable(c: Column, kind: str) -> Column:
    return c.try_cast(kind).isNotNull()


def has_keys(c: str, required: list[str], optional: list[str] | None = None) -> Column:
    """A map column has all required keys and, if ``optional`` is given, no others."""
    ok = F.lit(True)
    for k in required:
        ok = ok & F.map_contains_key(F.col(c), k)
    if optional is not None:
        allowed = F.array(*[F.lit(k) for k in required + optional])
        ok = ok & (F.size(F.array_except(F.map_keys(c), allowed)) == 0)
    return ok


def column_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(row_id, violation): one row per value that fails a rule."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(F.col(key).alias("row_id"), F.explode(found).alias("violation"))


def retrieval_succeeded(context: Column, quality: Column) -> Column:
    c = F.coalesce(context, F.lit(""))
    return ((F.length(T.strip(c)) >= 10) & ~T.contains_any(F.lower(c), V.FAILURE_PHRASES) & (quality > 0.3))


def parse_context(contexts: DataFrame) -> DataFrame:
    """(query_id, rank, source, text, ids) of an assembled context; ids are the numbers it cites."""
    mark = "\u0001"
    blocks = F.split(F.replace("context", F.lit("\n\n["), F.lit(f"\n{mark}[")), mark)
    ids = F.array_sort(F.transform(F.array_distinct(
        F.regexp_extract_all("context", F.lit(r"\[(\d+)\]"), F.lit(1))), lambda x: x.cast("int")))
    df = contexts.select("query_id", F.explode(blocks).alias("b"), ids.alias("ids"))
    return df.select(
        "query_id", F.regexp_extract("b", r"^\[(\d+)\]", 1).cast("int").alias("rank"),
        F.regexp_extract("b", r"^\[\d+\] From ([^:\n]*):", 1).alias("source"),
        F.regexp_replace("b", r"^[^\n]*\n|\n\z", "").alias("text"), "ids")


def parse_answer_json(reply: Column) -> list[Column]:
    """answer, sources, confidence of a JSON reply; any other reply is the answer itself at 0.5."""
    parsed = F.from_json(reply, "answer STRING, sources ARRAY<STRING>, confidence DOUBLE", {"mode": "PERMISSIVE"})
    ok = parsed["answer"].isNotNull()
    return [F.coalesce(parsed["answer"], T.strip(reply)).alias("answer"),
            F.when(ok, F.coalesce(parsed["sources"], F.array().cast("array<string>")))
            .otherwise(F.array().cast("array<string>")).alias("sources"),
            F.when(ok, F.coalesce(parsed["confidence"], F.lit(0.5))).otherwise(0.5).alias("confidence")]
