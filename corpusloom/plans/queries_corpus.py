"""Registered queries: sources and sinks (A), corpus preparation (B), text functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed_values as V, scores as S, text as T
from ..operators import checks, chunking, encoders, fusion
from ..session import scratch_folder
from ..sources import readers, sinks, versions
from . import ingest, sqlparts as Q
from .registry import query
from .tables import CHUNK_SIZE, DIMS, OVERLAP



# --- A: sources and sinks -------------------------------------------------------------------

@query("a1_read_text_corpus", f"""
    SELECT doc_id, lang, source, length(text) AS n_chars, md5(text) AS digest FROM documents
    WHERE {Q.strip("coalesce(text, '')")} <> ''""")
def _(t):
    docs, _rejects = readers.read_corpus(t.documents)
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


def _page_sql(c: str) -> str:
    for tag in ("script", "style", "nav"):
        c = Q.sub(c, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    c = Q.sub(c, r"(?s)<!--.*?-->", " ")
    c = Q.sub(c, r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', r"\2 [URL: \1]")
    c = Q.sub(c, r"(?i)<(?:br|/p|/div|/h\d|/li|/tr|/article)\b[^>]*>", "\n")
    c = Q.sub(c, r"(?s)<[^>]*>", "")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        c = f"replace({c}, {Q.lit(entity)}, {Q.lit(char)})"
    c = Q.sub(c, r"[ \t]+", " ")
    return Q.strip(Q.sub(c, r" ?\n[ \n]*", "\n"))


@query("a2_pages_to_text", f"SELECT page_id, url, {_page_sql('html')} AS text FROM pages")
def _(t):
    return readers.pages_to_text(t.pages)


def _written_files(t) -> str:
    """Texts of the documents as files: one file for each language and source, one line a document."""
    path = scratch_folder(t.spark, "files")
    lines = t.documents.select("lang", "source", F.concat_ws(":", "doc_id", F.md5(T.text_of("text"))).alias("value"))
    lines.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    return path


_FILES = "SELECT lang, source, sum(strlen(doc_id || ':' || md5(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents GROUP BY 1, 2"


def _folder_of(name: str):
    return F.regexp_extract("path", f"{name}=([^/]*)", 1).alias(name)


@query("a3_list_files", _FILES)
def _(t):
    return readers.list_files(t.spark, _written_files(t), "part-*.txt").select(_folder_of("lang"), _folder_of("source"), "size")


@query("a4_manifest_of_files", _FILES.replace("AS size", "AS size, '.txt' AS extension, true AS hashed"))
def _(t):
    files = readers.file_manifest(t.spark, _written_files(t), "part-*.txt")
    return files.select(_folder_of("lang"), _folder_of("source"), "size", "extension", (F.length("sha256") == 64).alias("hashed"))


@query("a1_read_text_files", "SELECT doc_id || ':' || md5(coalesce(text, '')) AS line FROM documents")
def _(t):
    docs, _rejects = readers.read_text_files(t.spark, _written_files(t))
    return docs.select(F.explode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("line"))


@query("a4_file_manifest", Q.sql("""
    SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size,
           coalesce(n, 0) AS chunk_count
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)"""))
def _(t):
    return readers.document_manifest(t.documents, t.chunks)


@query("a5_chunk_store_round_trip", """
    SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, min(len(embedding)) AS dims
    FROM embeddings GROUP BY 1""")
def _(t):
    path = scratch_folder(t.spark, "store")
    sinks.save_chunk_store(t.embeddings, path, partition_by="label")
    back = readers.load_chunk_store(t.spark, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"),
                                     F.max("vec_id").alias("last_id"), F.min(F.size("embedding")).alias("dims"))


@query("a5_versioned_store", """
    SELECT 1 AS version, count(*) AS n, count(*) FILTER (changed) AS changed FROM (SELECT vec_id % 3 = 0 AS changed FROM embeddings)""")
def _(t):
    """A store is replaced, then a third of its rows are upserted; a reader that was opened before still has the old rows."""
    path = scratch_folder(t.spark, "versions")
    rows = t.embeddings.select("vec_id", "label", F.lit(False).alias("changed"))
    versions.replace_store(rows, path, key="vec_id")
    versions.upsert_store(rows.filter("vec_id % 3 = 0").withColumn("changed", F.lit(True)), path, key="vec_id")
    version = versions.current(t.spark, path)[0]
    return versions.read_store(t.spark, path, rows.schema).agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))


@query("a6_update_store", """
    SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, 'append' AS first_mode, 'overwrite' AS second_mode,
           (SELECT count(*) FROM embeddings) AS after_append, min(len(embedding)) // 2 AS dims FROM embeddings""")
def _(t):
    path = scratch_folder(t.spark, "store")
    even = F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 0
    sinks.update_store(t.spark, path, t.embeddings.filter(even))
    first = sinks.update_store(t.spark, path, t.embeddings.filter(~even))
    n = t.spark.read.parquet(path).count()
    half = t.embeddings.withColumn("embedding", F.slice("embedding", F.lit(1), (F.size("embedding") / 2).cast("int")))
    second = sinks.update_store(t.spark, path, half)
    return t.spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.lit(first).alias("first_mode"),
        F.lit(second).alias("second_mode"), F.lit(n).cast("long").alias("after_append"),
        F.min(F.size("embedding")).alias("dims"))


def log_lines(events):
    """The event table as a JSON-lines query log; entries with k = 13 are cut off, sign-ups are routing events."""
    k = F.get_json_object("props", "$.k").cast("int")
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("query_hash"),
        F.col("value").alias("latency"), k.alias("hit_count"),
        F.when(F.col("event_type") == "signup", "engine_routing").alias("event_type"),
        F.struct(F.col("event_type").alias("search_type")).alias("metadata"))
    line = F.to_json(entry)
    return events.select(F.when(k == 13, F.left(line, F.lit(40))).otherwise(line).alias("value"))


@query("a7_read_jsonl_log", """
    SELECT event_type AS engine, count(*) AS n, round(sum(value), 4) AS latency,
           sum((props->>'$.k')::INT)::BIGINT AS hits, min(ts)::TIMESTAMP AS first_ts
    FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT <> 13 GROUP BY 1""")
def _(t):
    path = scratch_folder(t.spark, "log")
    log_lines(t.events).write.text(path)
    log = readers.read_jsonl_log(t.spark, path)
    return log.groupBy(F.col("metadata.search_type").alias("engine")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency"), 4).alias("latency"),
        F.sum("hit_count").alias("hits"), F.min("timestamp").alias("first_ts"))


@query("a8_write_jsonl_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark, "log")
    rows = t.events.select("event_id", "ts", "event_type", "value")
    sinks.write_jsonl_log(rows, path)
    sinks.write_jsonl_log(rows, path)
    return (t.spark.read.schema("event_id LONG, event_type STRING").json(path)
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("a9_read_qa", Q.sql("""
    SELECT 'conversations' AS source, question, answer FROM qa UNION ALL
    SELECT 'benchmark', query, query FROM queries"""))
def _(t):
    paths = {"conversations": scratch_folder(t.spark, "qa"), "benchmark": scratch_folder(t.spark, "qa")}
    line = F.to_json(F.array(F.struct("question", "answer")))
    t.qa.select(line).write.text(paths["conversations"])
    t.queries.select(F.col("query").alias("question"), F.col("query").alias("answer")).select(line).write.text(
        paths["benchmark"])
    return readers.read_qa(t.spark, paths, multi_line=False)


@query("a10_write_csv_summary", """
    SELECT event_type AS configuration, count(*) AS n, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1""")
def _(t):
    path = scratch_folder(t.spark, "summary")
    sinks.write_csv_summary(t.events.groupBy(F.col("event_type").alias("configuration")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_latency")), path)
    return t.spark.read.schema("configuration STRING, n LONG, avg_latency DOUBLE").option("header", True).csv(path)


@query("a11_qa_from_conversations", Q.sql("SELECT * FROM qa"))
def _(t):
    return t.qa


# --- B: corpus preparation ------------------------------------------------------------------

@query("b1_clamp_chunk_params", """
    SELECT doc_id, s AS size, CASE WHEN o < 100 THEN 150 WHEN o >= s // 2 THEN
             CASE WHEN s < 500 THEN least(o, s // 4) ELSE s // 4 END ELSE o END AS overlap
    FROM (SELECT doc_id, CASE WHEN n < 200 THEN 200 WHEN n > 2000 THEN 1500 ELSE n END AS s, o FROM (
      SELECT doc_id, n_chars::INT AS n, (n_chars // 3)::INT AS o FROM documents))""")
def _(t):
    size, overlap = chunking.clamp_chunk_params(
        F.col("n_chars").cast("int"), F.floor(F.col("n_chars") / 3).cast("int"))
    return t.documents.select("doc_id", size.alias("size"), overlap.alias("overlap"))


# Documents with the kinds of lines that extraction from print leaves: the tables have none of their own.
def _printed(t):
    return t.documents.select("doc_id", F.concat(
        F.lit("Contents\nChapter "), (F.col("doc_id") % 7).cast("string"), F.lit("\n...."), F.col("n_chars").cast("string"),
        F.lit("\nTable of Contents page 3\n"), F.regexp_replace("text", r"\. ", ".\n\n\n - "), F.lit("\n---\nPage 12\n 7 \nTOC\n"),
        F.col("source"), F.lit("\n2.\nFirst point\n • Item\n;\n==\nend of text")).alias("text"))


_PRINTED = """
    SELECT doc_id, 'Contents' || chr(10) || 'Chapter ' || doc_id % 7 || chr(10) || '....' || n_chars || chr(10)
      || 'Table of Contents page 3' || chr(10) || regexp_replace(text, '\\. ', '.' || chr(10) || chr(10) || chr(10) || ' - ', 'g')
      || chr(10) || '---' || chr(10) || 'Page 12' || chr(10) || ' 7 ' || chr(10) || 'TOC' || chr(10) || source
      || chr(10) || '2.' || chr(10) || 'First point' || chr(10) || ' • Item' || chr(10) || ';' || chr(10) || '=='
      || chr(10) || 'end of text' AS text FROM documents"""


@query("b2_filter_noise_lines", Q.sql(f"SELECT doc_id, {Q.noise_filtered('text')} AS text FROM printed", printed=_PRINTED))
def _(t):
    return _printed(t).select("doc_id", T.filter_noise_lines(F.col("text")).alias("text"))


@query("b3_repair_line_breaks", Q.sql(f"SELECT doc_id, {Q.breaks_repaired('text')} AS text FROM printed", printed=_PRINTED))
def _(t):
    return _printed(t).select("doc_id", T.repair_line_breaks(F.col("text")).alias("text"))


@query("b4_drop_thin_lines", Q.sql(f"SELECT doc_id, {Q.thin_dropped('text')} AS text FROM printed", printed=_PRINTED))
def _(t):
    return _printed(t).select("doc_id", T.drop_thin_lines(F.col("text")).alias("text"))


@query("b5_prepare_text", f"""
    SELECT doc_id, {Q.thin_dropped('b')} AS text FROM (SELECT doc_id, {Q.breaks_repaired('a')} AS b FROM (
      SELECT doc_id, {Q.noise_filtered('text')} AS a FROM documents))""")
def _(t):
    return t.documents.select("doc_id", T.prepare_text(F.col("text")).alias("text"))


@query("b6_chunk_text")
def _(t):
    return chunking.chunk_text(t.documents, CHUNK_SIZE, OVERLAP).select(
        "doc_id", "chunk_index", F.length("text").alias("chunk_size"), F.md5("text").alias("digest"))


@query("b6_chunk_text_basic")
def _(t):
    """The basic splitter, as a table function in SQL."""
    chunking.register_table_functions(t.spark)
    t.documents.createOrReplaceTempView("chunk_text_documents")
    return t.spark.sql(f"""
        SELECT doc_id, c.chunk_index, length(c.chunk) AS chunk_size, md5(c.chunk) AS digest
        FROM chunk_text_documents, LATERAL chunk_text(text, {CHUNK_SIZE}, {OVERLAP}, false) c""")


@query("b7_chunk_fixed", Q.sql("SELECT doc_id, chunk_index, text FROM raw_chunks"))
def _(t):
    return t.raw_chunks.select("doc_id", "chunk_index", "text")


@query("b8_format_chunks", Q.sql(f"""
    SELECT doc_id, chunk_index, chunk_id, length(text)::INT AS chunk_size, source, {CHUNK_SIZE} AS size,
           {OVERLAP} AS overlap FROM raw_chunks"""))
def _(t):
    rows = chunking.format_chunks(t.raw_chunks, CHUNK_SIZE, OVERLAP)
    return rows.select("doc_id", "chunk_index", "chunk_id", "chunk_size", "metadata.source",
                       "metadata.chunk_params.size", "metadata.chunk_params.overlap")


@query("b9_filter_valid_chunks", Q.sql("SELECT chunk_id, md5(text) AS digest FROM chunks"))
def _(t):
    return t.chunks.select("chunk_id", F.md5("text").alias("digest"))


# Lines of a document as its chunks: many of them are below 50 characters.
_LINES = """
    SELECT doc_id, (i - 1)::INT AS chunk_index, parts[i] AS text FROM (
      SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT doc_id, string_split(text, '. ') AS parts FROM documents))"""


def _lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("chunk_index", "text"))


@query("b10_merge_small_chunks", Q.sql("""
    SELECT doc_id, min(chunk_index) AS chunk_index, string_agg(text, ' ' ORDER BY chunk_index) AS text,
           count(*)::INT AS merged_chunks, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS original_indices
    FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS g FROM (
      SELECT *, CASE WHEN taken OR (is_last AND takes AND chunk_index > 0) THEN 0 ELSE 1 END AS head FROM (
        SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY chunk_index), false) AS taken FROM (
          SELECT *, small AND (chunk_index - coalesce(max(CASE WHEN NOT small THEN chunk_index END)
                   OVER (PARTITION BY doc_id ORDER BY chunk_index), -1)) % 2 = 1 AS takes FROM (
            SELECT *, length(text) < 50 AS small,
                   chunk_index = max(chunk_index) OVER (PARTITION BY doc_id) AS is_last FROM lines)))))
    GROUP BY doc_id, g""", lines=_LINES))
def _(t):
    return chunking.merge_small_chunks(_lines(t))


@query("b11_trim_to_sentence", Q.sql(f"""
    SELECT chunk_id, CASE WHEN {Q.rx(Q.rstrip('text'), '[.!?]$')} OR cut = '' THEN text
           ELSE {Q.rstrip('head || cut')} END AS text FROM (
      SELECT *, substr(text, 1, length(text) - n) AS head,
             regexp_extract(substr(text, length(text) - n + 1, n), '(?s)^(.*[.!?\\n])', 1) AS cut FROM (
        SELECT chunk_id, text, greatest(least(99, length(text) - 1), 0) AS n FROM raw_chunks))"""))
def _(t):
    return t.raw_chunks.select("chunk_id", T.trim_to_sentence(F.col("text")).alias("text"))


@query("b12_validate_chunks", Q.sql(f"""
    SELECT * FROM (
      SELECT doc_id || '-' || chunk_index AS chunk_id, unnest(list_filter([
             CASE WHEN text IS NULL THEN 'missing_text' END, CASE WHEN {Q.strip('text')} = '' THEN 'empty_text' END,
             CASE WHEN length(coalesce(text, '')) < 50 THEN 'below_minimum' END], lambda x: x IS NOT NULL)) AS issue,
             length(coalesce(text, ''))::INT AS size FROM lines)""", lines=_LINES))
def _(t):
    return chunking.validate_chunks(_lines(t).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")))


@query("b13_clean_context", f"SELECT doc_id, {Q.context_cleaned('text')} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.clean_context(F.col("text")).alias("text"))


@query("b14_similarity_threshold", Q.sql("SELECT query_id, chunk_id, score, rank FROM vec10 WHERE score >= 0.6"))
def _(t):
    return fusion.above(t.vector_hits(10), 0.6)


@query("b15_documents_by_source", "SELECT doc_id, source, n_chars FROM documents WHERE contains(source, 'c1')")
def _(t):
    return checks.documents_by_source(t.documents, "c1").select("doc_id", "source", "n_chars")


@query("b16_column_validity", rf"""
    SELECT * FROM (
      SELECT doc_id AS row_id, unnest(list_filter([
        CASE WHEN NOT n_chars BETWEEN 50 AND 20000 THEN 'n_chars_range' END,
        CASE WHEN NOT length(text) BETWEEN 100 AND 30000 THEN 'text_length' END,
        CASE WHEN NOT regexp_matches(lang || '@' || source || '.org', {Q.lit(V.EMAIL)}) THEN 'contact_email' END,
        CASE WHEN source IS NULL THEN 'source_required' END,
        CASE WHEN TRY_CAST(substr(source, 4) AS INT) IS NULL THEN 'source_number' END], lambda x: x IS NOT NULL)) AS violation
      FROM documents
      UNION ALL
      SELECT page_id, 'url' FROM pages WHERE NOT regexp_matches(url, {Q.lit(V.URL)}))""")
def _(t):
    docs = checks.column_violations(
        t.documents.withColumn("contact", F.concat("lang", F.lit("@"), "source", F.lit(".org"))), "doc_id", {
            "n_chars_range": checks.in_range("n_chars", 50, 20000),
            "text_length": checks.has_length("text", 100, 30000),
            "contact_email": checks.is_email("contact"),
            "source_required": checks.present("source"),
            "source_number": checks.castable(F.substring("source", 4, 100), "int")})
    pages = checks.column_violations(t.pages, "page_id", {"url": checks.is_url("url")})
    return docs.unionByName(pages)


@query("b17_assess_retrieval_success", Q.sql(f"""
    SELECT query_id, length({Q.strip('c')}) >= 10 AND NOT {Q.any_of('lower(c)', V.FAILURE_PHRASES)} AND q > 0.3 AS success
    FROM (SELECT query_id, coalesce(context, '{V.NO_CONTEXT}') AS c, coalesce(q, 0) AS q FROM queries
          LEFT JOIN ctx USING (query_id) LEFT JOIN (SELECT query_id, avg(score) AS q FROM over GROUP BY 1) USING (query_id))""",
    over="SELECT * FROM vec10 WHERE score >= 0.85",
    ctx=Q.context_sql("(SELECT query_id, rank, source, text FROM over JOIN chunks USING (chunk_id))", 3000)))
def _(t):
    hits = fusion.above(t.vector_hits(10), 0.85)
    contexts = fusion.contexts_for(t.queries, fusion.assemble_context(fusion.with_text(hits, t.chunks), 3000))
    quality = hits.groupBy("query_id").agg(F.avg("score").alias("quality"))
    return (contexts.join(quality, "query_id", "left")
            .select("query_id", checks.retrieval_succeeded(F.col("context"), F.coalesce("quality", F.lit(0.0))).alias("success")))


# --- C: text functions ----------------------------------------------------------------------

@query("c1_extract_links", rf"""
    SELECT page_id, (unnest(range(1, len(links) + 1)) - 1)::INT AS pos, unnest(links).text AS text, unnest(links).url AS url
    FROM (SELECT page_id, list_concat(linked, list_transform(list_filter(list_distinct(raw),
            lambda u: NOT list_contains(list_transform(linked, lambda x: x.url), u)), lambda u: {{'text': u, 'url': u}})) AS links
      FROM (SELECT page_id, list_concat(
          list_transform(list_zip(md_t, md_u), lambda z: {{'text': z[1], 'url': z[2]}}),
          list_transform(list_zip(a_t, a_u), lambda z: {{'text': z[1], 'url': z[2]}})) AS linked, raw
        FROM (SELECT page_id, {Q.every('h', '[[]([^]]+)[]][(]([^)]+)[)]', 1)} AS md_t, {Q.every('h', '[[]([^]]+)[]][(]([^)]+)[)]', 2)} AS md_u,
                {Q.every('h', '<a' + chr(92) + 's+href="([^"]+)"[^>]*>([^<]+)</a>', 2)} AS a_t,
                {Q.every('h', '<a' + chr(92) + 's+href="([^"]+)"[^>]*>([^<]+)</a>', 1)} AS a_u,
                {Q.every('h', T.RAW_URL, 1)} AS raw
              FROM (SELECT page_id, html || ' see ' || url || ' and [home](' || url || '#top)' AS h FROM pages))))
    WHERE len(links) > 0""")
def _(t):
    html = F.concat("html", F.lit(" see "), "url", F.lit(" and [home]("), "url", F.lit("#top)"))
    return (t.pages.select("page_id", F.posexplode(T.extract_links(html)).alias("pos", "link"))
            .select("page_id", "pos", "link.text", "link.url"))


@query("c2_extract_code_blocks", rf"""
    SELECT conv_id, turn, CASE WHEN l = '' THEN 'text' ELSE l END AS language, {Q.strip('c')} AS code FROM (
      SELECT conv_id, turn, unnest({Q.every('m', T.CODE_BLOCK, 1)}) AS l, unnest({Q.every('m', T.CODE_BLOCK, 2)}) AS c FROM (
        SELECT conv_id, turn, 'Answer:' || chr(10) || '```' || CASE WHEN role = 'user' THEN '' ELSE role END || chr(10)
               || text || chr(10) || '```' || chr(10) || '```sql' || chr(10) || 'select ' || turn || '```' AS m FROM conversations))""")
def _(t):
    m = F.concat(F.lit("Answer:\n```"), F.when(F.col("role") == "user", "").otherwise(F.col("role")), F.lit("\n"), "text",
                 F.lit("\n```\n```sql\nselect "), F.col("turn").cast("string"), F.lit("```"))
    return (t.conversations.select("conv_id", "turn", F.explode(T.extract_code_blocks(m)).alias("b"))
            .select("conv_id", "turn", "b.language", "b.code"))


@query("c3_extract_bullets_and_numbered", rf"""
    SELECT doc_id, array_to_string(list_transform({Q.every('m', '(?m)^[ \t\n\f\r]*[-*]' + chr(92) + 's+(.+)$')}, lambda x: {Q.strip('x')}), '|') AS bullets,
           array_to_string(list_transform({Q.every('m', '(?m)^[ \t\n\f\r]*[0-9]+[.)]' + chr(92) + 's+(.+)$')}, lambda x: {Q.strip('x')}), '|') AS numbered
    FROM (SELECT doc_id, '- ' || replace(replace(text, chr(10), chr(10) || '* '), '. ', '.' || chr(10) || '  2) ') AS m FROM documents)""")
def _(t):
    m = F.concat(F.lit("- "), F.replace(F.replace("text", F.lit("\n"), F.lit("\n* ")), F.lit(". "), F.lit(".\n  2) ")))
    return t.documents.select("doc_id", F.array_join(T.extract_bullets(m), "|").alias("bullets"),
                              F.array_join(T.extract_numbered(m), "|").alias("numbered"))


def key_terms_sql(c: str) -> str:
    marked = f"regexp_replace({c}, {Q.lit('(' + V.WORD + '+)')}, chr(2) || '\\1' || chr(3), 'g')"
    phrase = "(\\x02[A-Z][a-zA-Z]*\\x03(?:\\s+\\x02[A-Z][a-zA-Z]*\\x03){0,5})"
    common = "[" + ", ".join(Q.lit(w) for w in V.COMMON_CAPITALISED) + "]"
    return (f"list_slice(list_filter(list_transform(regexp_extract_all({marked}, {Q.lit(phrase)}, 1), "
            f"lambda p: replace(replace(p, chr(2), ''), chr(3), '')), "
            f"lambda p: NOT list_contains({common}, p) AND length(p) > 2), 1, 10)")


@query("c4_extract_key_terms", f"SELECT doc_id, array_to_string({key_terms_sql('text')}, '|') AS key_terms FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(T.extract_key_terms(F.col("text")), "|").alias("key_terms"))


def heading_sql(c: str) -> str:
    title = f"regexp_extract({c}, {Q.lit('^([' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's' + chr(92) + '-]+)(?:' + chr(92) + 'n|:)')}, 1)"
    sentence = f"regexp_extract({c}, '^([^.!?]+[.!?])', 1)"
    return (f"CASE WHEN {title} <> '' THEN {Q.strip(title)} WHEN {sentence} <> '' THEN {Q.strip(sentence)} "
            f"ELSE {Q.strip(f'left({c}, 50)')} || '...' END")


@query("c5_extract_heading", f"SELECT doc_id, {heading_sql('text')} AS heading FROM documents")
def _(t):
    return t.documents.select("doc_id", T.extract_heading(F.col("text")).alias("heading"))


def facts_sql(c: str) -> str:
    return (f"list_sort(list_distinct(list_concat({Q.every(c, '(' + chr(92) + 'b' + V.PHONE + chr(92) + 'b)')}, "
            f"{Q.every(c, '(' + chr(92) + 'b' + V.NUMBER + chr(92) + 'b)')}, {Q.every(c, '(' + V.MONEY + ')')})))")


_FACTS = "text || ' call 555-' || (100 + doc_id % 900) || '-0123 for $' || n_chars || '.50 or ' || doc_id"


def facts_text():
    return F.concat("text", F.lit(" call 555-"), (100 + F.col("doc_id") % 900).cast("string"), F.lit("-0123 for $"),
                    F.col("n_chars").cast("string"), F.lit(".50 or "), F.col("doc_id").cast("string"))


@query("c6_extract_facts", f"SELECT doc_id, array_to_string({facts_sql(_FACTS)}, '|') AS facts FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(T.extract_facts(facts_text()), "|").alias("facts"))


@query("c7_jaccard_words", Q.sql(f"SELECT query_id, round({Q.jaccard('question', 'answer')}, 6) AS jaccard FROM qa"))
def _(t):
    return t.qa.select("query_id", F.round(T.jaccard_words(F.col("question"), F.col("answer")), 6).alias("jaccard"))


@query("c8_word_overlap", Q.sql(f"SELECT query_id, round({Q.overlap('question', 'answer')}, 6) AS overlap FROM qa"))
def _(t):
    return t.qa.select("query_id", F.round(T.word_overlap(F.col("question"), F.col("answer")), 6).alias("overlap"))


@query("c9_vector_arithmetic", Q.sql(f"""
    SELECT vec_id, round({Q.cosine('e.embedding', 'c.embedding')}, 6) AS cosine,
           round(list_inner_product(e.embedding::DOUBLE[], c.embedding), 6) AS dot,
           round(e.embedding[1]::DOUBLE / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS first_normalized
    FROM embeddings e JOIN centres c ON c.query_id = e.label"""))
def _(t):
    c = t.class_centres.select(F.col("query_id").alias("label"), F.col("embedding").alias("c"))
    e = F.col("embedding")
    return t.embeddings.join(c, "label").select(
        "vec_id", F.round(S.cosine(e, F.col("c")), 6).alias("cosine"), F.round(S.dot(e, F.col("c")), 6).alias("dot"),
        F.round(S.l2_normalize(e)[0], 6).alias("first_normalized"))


@query("c10_sparse_dot", Q.sql("SELECT query_id, chunk_id, score FROM sparse"))
def _(t):
    return t.sparse_scores


@query("c11_normalize_and_containment", Q.sql(f"""
    SELECT query_id, a AS normalized, round(CASE WHEN contains(b, a) THEN length(a)::DOUBLE / length(b)
           WHEN contains(a, b) THEN length(b)::DOUBLE / length(a) ELSE 0 END, 6) AS containment
    FROM (SELECT query_id, {Q.normalized('question')} AS a, {Q.normalized("question || '! ' || answer")} AS b FROM qa)"""))
def _(t):
    both = F.concat("question", F.lit("! "), "answer")
    return t.qa.select("query_id", T.normalize_text(F.col("question")).alias("normalized"),
                       F.round(T.containment(F.col("question"), both), 6).alias("containment"))


@query("c12_sequence_ratio")
def _(t):
    from ..operators.dedup import sequence_ratio
    pairs = (fusion.with_text(t.bm25_hits(5), t.chunks).join(t.queries, "query_id")
             .withColumn("a", T.normalize_text(F.col("query"))).withColumn("b", T.normalize_text(F.col("text"))))
    return pairs.select("query_id", "chunk_id", F.round(sequence_ratio("a", "b"), 6).alias("ratio"))


def _bands_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} > {n} THEN {Q.lit(w)}" for n, w in V.CONFIDENCE_BANDS) + f" ELSE {Q.lit(V.CONFIDENCE_FLOOR)} END"


@query("c13_confidence_score", Q.sql(f"""
    SELECT query_id, s AS score, CASE WHEN s IS NOT NULL THEN {_bands_sql('s')} END AS band FROM (
      SELECT query_id, nullif(regexp_extract(a, 'Confidence score: (\\d+)%', 1), '')::INT AS s FROM (
        SELECT query_id, answer || CASE WHEN length(answer) % 3 = 0 THEN ' no score'
               ELSE ' Confidence score: ' || length(answer) % 101 || '%' END AS a FROM qa))"""))
def _(t):
    n = F.length("answer")
    answer = F.concat("answer", F.when(n % 3 == 0, " no score").otherwise(
        F.concat(F.lit(" Confidence score: "), (n % 101).cast("string"), F.lit("%"))))
    score = T.confidence_score(answer)
    return t.qa.select("query_id", score.alias("score"), T.confidence_band(score).alias("band"))


_UNSURE = """replace(answer, '. ', '. <uncertain>the fee is free</uncertain> Billable items are different from '
             || split_part(question, ' ', 1) || '. ')"""


@query("c14_mark_uncertain", Q.sql(rf"""
    SELECT query_id, len({Q.every('a', '(?s)<uncertain>(.*?)</uncertain>')})::INT AS uncertain,
           {' + '.join(f"len({Q.every('a', '(?i)(' + p + ')')})" for p in V.TERM_DISTINCTIONS)} AS distinctions,
           coalesce({', '.join(f"CASE WHEN {Q.rx('a', '(?i)' + p)} THEN {Q.lit(n)} END" for p, n in V.CONFUSED_TERMS)}) AS confusion
    FROM (SELECT query_id, {_UNSURE} AS a FROM qa)"""))
def _(t):
    a = F.replace("answer", F.lit(". "), F.concat(
        F.lit(". <uncertain>the fee is free</uncertain> Billable items are different from "),
        F.split_part("question", F.lit(" "), F.lit(1)), F.lit(". ")))
    return t.qa.select("query_id", F.size(T.uncertain_spans(a)).alias("uncertain"),
                       F.size(T.term_distinctions(a)).cast("long").alias("distinctions"),
                       T.confusion_warning(a).alias("confusion"))


@query("c15_answer_structure", Q.sql(r"""
    SELECT query_id, regexp_matches(a, '(?:[1-9]|10)[.)]') AS has_numbered, contains(a, '•') OR contains(a, '*')
           OR regexp_matches(a, '(?m)^\s*-\s') AS has_bullets,
           contains(lower(a), 'example') OR contains(lower(a), 'for instance') AS has_examples
    FROM (SELECT query_id, CASE length(answer) % 4 WHEN 0 THEN '- ' || replace(answer, '. ', chr(10) || '- ')
          WHEN 1 THEN '1. ' || answer WHEN 2 THEN 'For instance ' || answer ELSE answer END AS a FROM qa)"""))
def _(t):
    n = F.length("answer") % 4
    a = (F.when(n == 0, F.concat(F.lit("- "), F.replace("answer", F.lit(". "), F.lit("\n- "))))
         .when(n == 1, F.concat(F.lit("1. "), "answer")).when(n == 2, F.concat(F.lit("For instance "), "answer"))
         .otherwise(F.col("answer")))
    return t.qa.select("query_id", T.has_numbered_steps(a).alias("has_numbered"), T.has_bullets(a).alias("has_bullets"),
                       T.has_examples(a).alias("has_examples"))


_BM_CONTEXT = Q.context_sql("(SELECT query_id, rank, source, text FROM bm10 JOIN chunks USING (chunk_id))", 6000)


@query("c16_parse_context", Q.sql("""
    SELECT query_id, regexp_extract(b, '^\\[(\\d+)\\]', 1)::INT AS rank,
           regexp_extract(b, '^\\[\\d+\\] From ([^:\\n]*):', 1) AS source, md5(regexp_replace(b, '^[^\\n]*\\n|\\n$', '', 'g')) AS digest,
           ids FROM (
      SELECT query_id, unnest(string_split(replace(context, chr(10) || chr(10) || '[', chr(10) || chr(1) || '['), chr(1))) AS b,
             array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(context, '\\[(\\d+)\\]', 1)),
               lambda x: x::INT)), lambda x: x::VARCHAR), ',') AS ids FROM ctx)""", ctx=_BM_CONTEXT))
def _(t):
    contexts = fusion.assemble_context(fusion.with_text(t.bm25_hits(10), t.chunks), 6000)
    return checks.parse_context(contexts).select("query_id", "rank", "source", F.md5("text").alias("digest"),
                                                 F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("c17_parse_answer_json", Q.sql("""
    SELECT query_id, CASE WHEN length(answer) % 5 = 0 THEN trim(left(answer, 100), ' ' || chr(10)) ELSE answer END AS answer,
           CASE WHEN length(answer) % 5 = 0 THEN '' ELSE 'q' || query_id END AS sources,
           CASE WHEN length(answer) % 5 = 0 THEN 0.5 ELSE (length(answer) % 100) / 100.0 END AS confidence FROM qa"""))
def _(t):
    n = F.length("answer")
    doc = F.to_json(F.struct("answer", F.array(F.concat(F.lit("q"), F.col("query_id").cast("string"))).alias("sources"),
                             ((n % 100) / 100.0).alias("confidence")))
    reply = F.when(n % 5 == 0, F.concat(F.lit(" "), F.left("answer", F.lit(100)), F.lit("\n"))).otherwise(doc)
    return t.qa.select("query_id", *checks.parse_answer_json(reply)).withColumn("sources", F.array_join("sources", ","))


@query("c18_sanitize_and_preview", r"""
    SELECT doc_id, replace('```' || text, '```', '\`\`\`') AS sanitized,
           regexp_replace(regexp_replace(' ' || source || ':' || lang || '?.txt.', '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS filename,
           CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '...' END AS preview FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", T.sanitize(F.concat(F.lit("```"), "text", F.lit("\u0000"))).alias("sanitized"),
        T.clean_filename(F.concat(F.lit(" "), "source", F.lit(":"), "lang", F.lit("?.txt."))).alias("filename"),
        T.preview(F.col("text"), 80).alias("preview"))


@query("c19_query_hash")
def _(t):
    return t.queries.select("query_id", T.query_hash(F.col("query")).alias("query_hash"))


@query("c20_word_count", f"SELECT doc_id, len({Q.tokens('text')})::INT AS words, length(text)::INT AS chars FROM documents")
def _(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query("c21_date_functions", """
    SELECT user_id, min(ts)::TIMESTAMP AS first_ts, date_diff('day', min(ts)::DATE, DATE '2024-02-01') AS age_days,
           round(epoch(max(ts)) - epoch(min(ts)), 3) AS duration_seconds FROM events GROUP BY 1""")
def _(t):
    # Times go through their ISO text form, as in a log.
    ts = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")
    seconds = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6
    return t.events.select("user_id", ts.alias("t")).groupBy("user_id").agg(
        F.min("t").alias("first_ts"),
        F.date_diff(F.lit("2024-02-01").cast("date"), F.min("t").cast("date")).cast("long").alias("age_days"),
        F.round(seconds, 3).alias("duration_seconds"))


@query("c22_specificity_and_completeness", Q.sql(f"""
    SELECT query_id, round(least({Q.count_of('lower(answer)', V.SPECIFIC_MARKS)} / 3.0, 1.0), 6) AS specificity,
           CASE WHEN answer = '' OR answer = 'ERROR' THEN 0.0 WHEN length(answer) < 100 THEN 0.3
                WHEN length(answer) < 250 THEN 0.7 ELSE 1.0 END AS completeness FROM qa"""))
def _(t):
    return t.qa.select("query_id", F.round(T.specificity(F.col("answer")), 6).alias("specificity"),
                       T.completeness_by_length(F.col("answer")).alias("completeness"))


# --- the ingest plan ---------------------------------------------------------------------------

@query("ingest_documents")
def _(t):
    """All documents through the ingest plan into a versioned store, read back."""
    path = scratch_folder(t.spark, "ingested")
    ingest.ingest(t.documents, path, CHUNK_SIZE, OVERLAP, encoders.hashing_encoder(DIMS), DIMS)
    return ingest.store(t.spark, path).select("chunk_id", "source", "metadata.chunk_size", "metadata.digest")
