"""SQL text for the checks: expression helpers and shared common table expressions for DuckDB."""

from __future__ import annotations

import re

from ..functions import fixed_values as V, text as T
from .tables import CHUNK_SIZE, DIMS, OVERLAP


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def sub(column: str, pattern: str, to: str = "", flags: str = "g") -> str:
    new = "||chr(10)||".join(lit(p) for p in to.split("\n")) if "\n" in to else lit(to)
    return f"regexp_replace({column}, {lit(pattern)}, {new}, '{flags}')"


def strip(c: str) -> str:
    return sub(c, r"^\s+|\s+$")


def rstrip(c: str) -> str:
    return sub(c, r"\s+$")


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"


def words(c: str) -> str:
    return f"list_distinct({tokens(c)})"


def terms(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {lit('(' + V.WORD + '{2,})')}, 1)"


def every(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({c}, {lit(pattern)}, {group})"


def overlap(q: str, t: str) -> str:
    return (f"CASE WHEN len({words(q)}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({words(q)}, {words(t)}))::DOUBLE / len({words(q)}) END")


def jaccard(a: str, b: str) -> str:
    x, y = words(a), words(b)
    return (f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / "
            f"len(list_distinct(list_concat({x}, {y}))) END")


def any_of(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(p)})" for p in phrases) + ")"


def count_of(c: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {lit(p)})::INT" for p in phrases) + ")"


def normalized(c: str) -> str:
    return strip(sub(sub(f"lower({c})", r"\s+", " "), r"[^\p{L}\p{N}_\s]"))


def valid(c: str) -> str:
    bare = strip(c)
    return (f"length({bare}) >= 50 AND {rx(c, '[a-zA-Z]')} AND NOT {rx(bare, T.NOISE_LINE)} "
            f"AND NOT {rx(bare, T.TOC_FOOTER_LINE)}")


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def noise_filtered(c: str) -> str:
    lines = f"string_split({c}, chr(10))"
    bare = strip("x")
    ahead = f"array_to_string(list_slice({lines}, i, i + 4), chr(10))"
    keep = (f"{bare} = '' OR ({rx(bare, T.TOC_HEADER_LINE)} AND {rx(ahead, '(?i)' + V.TOC_STRUCTURE)}) "
            f"OR NOT ({rx(bare, T.TOC_FOOTER_LINE)} OR {rx(bare, T.NOISE_LINE)})")
    return f"array_to_string(list_filter({lines}, lambda x, i: {keep}), chr(10))"


def breaks_repaired(c: str) -> str:
    c = sub(c, r"\n\s*\n\s*\n+", "\n\n")
    c = sub(c, r"\n\s*-\s*([A-Z])", "\n- \\1")
    c = sub(c, r"\n\s*•\s*([A-Z])", "\n• \\1")
    for _ in range(3):  # a run of white space before a small letter has at most two line ends here
        c = sub(c, r"\n(\s*[a-z])", r" \1")
    c = sub(c, r"\n\s*(\d+\.)\s*([A-Z])", "\n\\1 \\2")
    return sub(c, r"\n\s*[.,;:]\s*\n", "\n")


def thin_dropped(c: str) -> str:
    return (f"array_to_string(list_filter(string_split({c}, chr(10)), lambda x: "
            f"length({strip('x')}) >= 10 OR {rx('x', V.WORD)}), chr(10))")


def context_cleaned(c: str) -> str:
    c = sub(c, r"\s+", " ")
    c = sub(c, rf"({V.WORD})-\s*({V.WORD})", r"\1\2")
    c = sub(c, r"(?is)Table of Contents.*")
    c = sub(c, r"\. ([A-Z])", ".\n\n\\1")
    return strip(c)


def hash_vectors(source: str, key: str, text: str) -> str:
    """Signed feature hashing of words in long form (key, d, x), unit length."""
    return f"""
      SELECT {key}, d, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM (
        SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {DIMS} AS d,
               sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT < 128 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
        FROM (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest({tokens(text)}) AS w FROM {source}))
        GROUP BY 1, 2) WHERE x <> 0"""


def ranked(source: str, k: int | None, by: str = "query_id", tie: str = "chunk_id") -> str:
    cut = f" QUALIFY rank <= {k}" if k is not None else ""
    return (f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie})::INT AS rank "
            f"FROM {source}{cut}")


def rerank_sql(candidates: str, k: int) -> str:
    """Default pair scorer over candidates(query_id, chunk_id, score)."""
    return f"""
      SELECT query_id, chunk_id, original_score, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
        SELECT c.query_id, c.chunk_id, c.score AS original_score,
          CASE WHEN c.n <= {k} THEN c.score ELSE round(
            0.5 * len(list_intersect(q.ws, t.ws))::DOUBLE / len(q.ws)
            + 0.3 * coalesce((SELECT sum(r.idf) FROM ready_terms r WHERE r.query_id = c.query_id
                              AND list_contains(t.ws, r.term)), 0) / q.idf
            + 0.2 * CASE WHEN len(q.ps) = 0 THEN 0.0 ELSE len(list_intersect(q.ps, t.ps))::DOUBLE / len(q.ps) END
          , 6) END AS score
        FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM {candidates}) c
        JOIN ready q USING (query_id) JOIN chunk_words t USING (chunk_id))
      QUALIFY rank <= {k}"""


def pairs_of(list_sql: str) -> str:
    return (f"list_distinct(list_transform(range(1, len({list_sql})), "
            f"lambda i: {list_sql}[i] || ' ' || {list_sql}[i + 1]))")


def context_sql(hits: str, max_len: int) -> str:
    """Numbered context of hits(query_id, rank, source, text)."""
    return f"""
      SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context, count(*)::INT AS n_chunks FROM (
        SELECT query_id, rank, CASE WHEN upto <= {max_len} THEN block
               WHEN rank = 1 THEN left(block, {max(0, max_len - 3)}) || '...' END AS block FROM (
          SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM (
            SELECT query_id, rank, '[' || rank || '] From ' || coalesce(source, 'Unknown source') || ':'
                   || chr(10) || text || chr(10) AS block FROM {hits})))
      WHERE block IS NOT NULL GROUP BY query_id"""


STEP = CHUNK_SIZE - OVERLAP

CTES: dict[str, str] = {
    "queries": "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark",
    "raw_chunks": f"""
      SELECT doc_id, source, lang, (i / {STEP})::INT AS chunk_index, substr(t, i + 1, {CHUNK_SIZE}) AS text,
             doc_id || '-' || (i / {STEP})::INT AS chunk_id
      FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t,
                   unnest(range(0, length(coalesce(text, '')), {STEP})) AS i FROM documents)""",
    "chunks": f"SELECT * FROM raw_chunks WHERE {valid('text')}",
    "qa": """
      SELECT query_id, question, answer FROM (
        SELECT conv_id * 1000000 + turn AS query_id, role, text AS question,
               lead(text) OVER w AS answer, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'user' AND next_role = 'assistant'""",
    # words
    "chunk_tokens": f"SELECT chunk_id, unnest({tokens('text')}) AS term FROM chunks",
    "postings": """
      SELECT chunk_id, term, tf, sum(tf) OVER (PARTITION BY chunk_id)::INT AS dl FROM (
        SELECT chunk_id, term, count(*) AS tf FROM chunk_tokens GROUP BY 1, 2)""",
    "vocabulary": "SELECT term, count(*) AS df FROM postings GROUP BY 1",
    "totals": f"SELECT count(*) AS n, avg(len({tokens('text')})) AS avgdl FROM chunks",
    "query_terms": f"""
      SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM queries)
      GROUP BY 1, 2""",
    "bm25_idf": f"""
      SELECT term, CASE WHEN raw < 0 THEN {V.BM25_EPSILON} * (avg(raw) OVER ()) ELSE raw END AS idf FROM (
        SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM vocabulary, totals)""",
    "bm25": f"""
      SELECT query_id, chunk_id, round(sum(qtf * idf * tf * {V.BM25_K1 + 1} / (tf + {V.BM25_K1} * (1 - {V.BM25_B}
             + {V.BM25_B} * dl / avgdl))), 6) AS score
      FROM postings JOIN query_terms USING (term) JOIN bm25_idf USING (term), totals GROUP BY 1, 2""",
    "keyword": f"""
      SELECT * FROM (
        SELECT query_id, chunk_id, round(sum(list_contains(ws, word)::INT)::DOUBLE / any_value(nw)
               + 0.1 * sum((length(low) - length(replace(low, word, ''))) // length(word)), 6) AS score
        FROM (SELECT chunk_id, lower(text) AS low, {words('text')} AS ws FROM chunks),
             (SELECT query_id, len({words('query')}) AS nw, unnest({words('query')}) AS word FROM queries)
        WHERE contains(low, word) GROUP BY 1, 2) WHERE score > 0""",
    # TF-IDF and sparse
    "chunk_terms": f"SELECT chunk_id, unnest({terms('text')}) AS term FROM chunks",
    "tf": "SELECT chunk_id, term, count(*) AS tf FROM chunk_terms GROUP BY 1, 2",
    "smooth_idf": """
      SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
        (SELECT term, count(*) AS df FROM tf GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM chunks)""",
    "tfidf": """
      SELECT chunk_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) AS weight FROM (
        SELECT chunk_id, term, tf * idf AS raw FROM tf JOIN smooth_idf USING (term))""",
    "query_tf": f"""
      SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('query')}) AS term FROM queries)
      GROUP BY 1, 2""",
    "query_tfidf": """
      SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM (
        SELECT query_id, term, qtf * idf AS raw FROM query_tf JOIN smooth_idf USING (term))""",
    "followers": f"""
      SELECT term, other, c / sum(c) OVER (PARTITION BY term) AS share,
             row_number() OVER (PARTITION BY term ORDER BY c DESC, other) AS pos FROM (
        SELECT term, other, count(*) AS c FROM (
          SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i])) AS term,
                 unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) AS other
          FROM (SELECT {terms('text')} AS w FROM chunks))
        WHERE term IN (SELECT term FROM query_tf) GROUP BY 1, 2)
      QUALIFY pos <= 3""",
    "sparse_q": """
      SELECT query_id, term, weight FROM (
        SELECT query_id, term, sum(weight) AS weight FROM (
          SELECT query_id, term, weight FROM query_tfidf UNION ALL
          SELECT query_id, other, 0.5 * weight * share FROM query_tfidf JOIN followers USING (term))
        GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, term) <= 100""",
    "sparse_d": """
      SELECT chunk_id, term, weight FROM tfidf
      QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(weight, 6) DESC, term) <= 100""",
    "sparse": """
      SELECT query_id, chunk_id, round(sum(q.weight * d.weight) / any_value(norm), 6) AS score
      FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY query_id)) AS norm FROM sparse_q) q
      JOIN sparse_d d USING (term) GROUP BY 1, 2""",
    # vectors
    "chunk_vec": hash_vectors("chunks", "chunk_id", "text"),
    "query_vec": hash_vectors("queries", "query_id", "query"),
    "vec": """
      SELECT q.query_id, c.chunk_id, round(coalesce(s, 0) + 1e-9, 6) AS score FROM queries q CROSS JOIN chunks c LEFT JOIN (
        SELECT query_id, chunk_id, sum(q.x * c.x) AS s FROM query_vec q JOIN chunk_vec c USING (d) GROUP BY 1, 2)
      USING (query_id, chunk_id)""",
    "centres": """
      SELECT label::BIGINT AS query_id, list(x ORDER BY d) AS embedding FROM (
        SELECT label, d, round(avg(x::DOUBLE), 6) AS x FROM (
          SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
        GROUP BY 1, 2) GROUP BY 1""",
    "centre_scores": f"""
      SELECT query_id, vec_id, round({cosine('c.embedding', 'e.embedding')} + 1e-9, 6) AS score
      FROM centres c, embeddings e""",
    # hits
    "vec20": ranked("vec", 20),
    "kw20": ranked("keyword", 20),
    "bm10": ranked("bm25", 10),
    "vec10": ranked("vec", 10),
    "ready_terms": """
      SELECT query_id, term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf
      FROM query_terms LEFT JOIN vocabulary USING (term), (SELECT count(*)::DOUBLE AS n FROM chunks)""",
    "ready": f"""
      SELECT query_id, {words('query')} AS ws, {pairs_of('(' + tokens('query') + ')')} AS ps, idf FROM queries
      JOIN (SELECT query_id, sum(idf) AS idf FROM ready_terms GROUP BY 1) USING (query_id)""",
    "chunk_words": f"""
      SELECT chunk_id, list_distinct(tk) AS ws, {pairs_of('tk')} AS ps
      FROM (SELECT chunk_id, {tokens('text')} AS tk FROM chunks)""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the shared (and extra) expressions it needs in front of it."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in known:
            if name != own and name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    head = ",\n".join(f"{n} AS {'' if re.search(rf'{chr(92)}b{n}{chr(92)}b', known[n]) else 'MATERIALIZED '}({known[n]})"
                      for n in order)
    return f"WITH RECURSIVE {head}\n{body}"


def sized(size: int, overlap: int, queries: str, **extra: str) -> dict[str, str]:
    """The shared (and extra) expressions for another chunk size and other queries, their names ending in the size.

    Names are replaced wherever they stand, columns included, so all texts agree.
    """
    step = size - overlap
    raw = (CTES["raw_chunks"].replace(f"/ {STEP})", f"/ {step})").replace(f", {CHUNK_SIZE})", f", {size})").replace(f", {STEP})) AS i", f", {step})) AS i"))
    known = {**CTES, "queries": queries, "raw_chunks": raw, **extra}
    names = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    return {f"{n}_{size}": names.sub(rf"\1_{size}", text) for n, text in known.items()}
