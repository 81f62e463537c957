"""Quality of retrieved contexts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import scores as S, text as T


def length_score(n: Column) -> Column:
    return (F.when(n < 500, n / 500.0).when(n <= 5000, 1.0)
            .otherwise(F.greatest(F.lit(0.5), 1 - (n - 5000) / 10000.0)))


def context_quality(query: Column, context: Column, scores: Column) -> Column:
    """Mean of: average similarity (kept in [0, 1]), 1 - variance, fitting length, query word share.

    The variance counts with two scores or more, the word share if the query has words. No scores or
    no context gives 0.
    """
    s = F.transform(scores, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    parts = F.array_compact(F.array(
        S.array_mean(s),
        F.when(F.size(s) > 1, F.greatest(F.lit(0.0), 1 - S.array_var_pop(s))),
        length_score(F.length(context)),
        F.when(F.size(T.word_set(query)) > 0, T.word_overlap(query, context))))
    return F.when((F.coalesce(F.size(scores), F.lit(0)) == 0) | (F.coalesce(context, F.lit("")) == ""), F.lit(0.0)
                  ).otherwise(S.array_mean(parts))
