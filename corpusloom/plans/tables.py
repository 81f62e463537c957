"""The given tables and the relations derived from them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores as S, text as T
from ..operators import chunking, encoders, fusion, lexical, vectors
from ..session import cut_lineage, scratch_folder, spread_small, write_step

CHUNK_SIZE, OVERLAP = 1000, 150
DIMS = 64


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._indexes = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return spread_small(self.spark.read.parquet(f"{self.folder}/documents.parquet"), "doc_id")

    @property
    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), T.text_of("text").alias("query"))

    @property
    def raw_chunks(self) -> DataFrame:
        docs = self.documents.select("doc_id", "source", "lang", T.text_of("text").alias("text"))
        return (chunking.chunk_fixed(docs, CHUNK_SIZE, OVERLAP)
                .withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")))

    @property
    def chunks(self) -> DataFrame:
        """(doc_id, source, lang, chunk_index, text, chunk_id) of all documents, valid chunks only."""
        return self._indexes.get("chunks") or chunking.filter_valid_chunks(self.raw_chunks)

    def store(self, *names: str) -> "Tables":
        """Write the chunks and their vectors (or the named ones) once; every later part of this object reads them."""
        for name in names or ("chunks", "chunk_vectors"):
            if name not in self._indexes:
                self._indexes[name] = write_step(getattr(self, name), scratch_folder(self.spark, name))
        return self

    def index(self, words=T.tokens) -> lexical.TermIndex:
        """The stored term index of the chunks; written at its first use."""
        if words not in self._indexes:
            self._indexes[words] = lexical.build_postings(self.chunks, words).stored(scratch_folder(self.spark, "terms"))
        return self._indexes[words]

    @property
    def chunk_vectors(self) -> DataFrame:
        return self._indexes.get("chunk_vectors") or (encoders.embed(self.chunks.select("chunk_id", "text"), encoders.hashing_encoder(DIMS), dims=DIMS)
                .select("chunk_id", "embedding"))

    def cells(self, name: str, key: str) -> vectors.CellStore:
        """The vectors of that name in a store by cell; written at its first use."""
        if f"cells-{name}" not in self._indexes:
            path = scratch_folder(self.spark, f"cells-{name}")
            vectors.write_cells(getattr(self, name), path, key)
            self._indexes[f"cells-{name}"] = vectors.open_cells(self.spark, path, key)
        return self._indexes[f"cells-{name}"]

    @property
    def query_vectors(self) -> DataFrame:
        return (encoders.embed(self.queries, encoders.hashing_encoder(DIMS), text="query", dims=DIMS)
                .select("query_id", "embedding"))

    @property
    def class_centres(self) -> DataFrame:
        """Query vectors for the embedding table: the mean vector of each label, ten numbers of digits
        fixed so that every engine sees the same query."""
        dims = self.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
        mean = dims.groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        return (mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
                .select(F.col("label").cast("long").alias("query_id"),
                        F.transform("v", lambda e: e["x"]).alias("embedding")))

    # hits of the benchmark queries over the document chunks
    def _hits(self, name: str, k: int, search) -> DataFrame:
        """Hits are kept; those of a shallower search are the first ranks of a deeper one."""
        depth, kept = self._indexes.get(f"{name}-hits", (0, None))
        if depth < k:
            depth, kept = self._indexes[f"{name}-hits"] = k, cut_lineage(search())
        return kept if depth == k else kept.filter(F.col("rank") <= k)

    def vector_hits(self, k: int) -> DataFrame:
        return self._hits("vector", k, lambda: vectors.knn_exact(self.query_vectors, self.store("chunk_vectors").chunk_vectors, k))

    def keyword_hits(self, k: int) -> DataFrame:
        return self._hits("keyword", k, lambda: lexical.keyword_search(self.queries, self.index(), k))

    def bm25_hits(self, k: int) -> DataFrame:
        return self._hits("bm25", k, lambda: lexical.bm25_search(self.queries, self.index(), k))

    @property
    def sparse_texts(self) -> DataFrame:
        """Stored: the weights of a text are made once and read by every search."""
        if "sparse" not in self._indexes:
            self._indexes["sparse"] = write_step(lexical.sparse_expand(lexical.tfidf_rows(self.index(T.terms))), scratch_folder(self.spark, "sparse"))
        return self._indexes["sparse"]

    @property
    def sparse_queries(self) -> DataFrame:
        if "sparse_queries" not in self._indexes:
            self._indexes["sparse_queries"] = cut_lineage(
                lexical.sparse_queries(self.queries, self.chunks, self.index(T.terms)))
        return self._indexes["sparse_queries"]

    @property
    def sparse_scores(self) -> DataFrame:
        return lexical.sparse_scores(self.sparse_queries, self.sparse_texts)

    def sparse_hits(self, k: int) -> DataFrame:
        return lexical.sparse_search(self.sparse_queries, self.sparse_texts, k, bounds=self.sparse_bounds)

    @property
    def sparse_bounds(self) -> DataFrame:
        if "sparse_bounds" not in self._indexes:
            self._indexes["sparse_bounds"] = cut_lineage(lexical.term_bounds(self.sparse_texts))
        return self._indexes["sparse_bounds"]

    def reranked(self, candidates: DataFrame, k: int) -> DataFrame:
        return fusion.rerank(candidates, self.chunks, fusion.ready_queries(self.queries, self.index()), k)

    @property
    def qa(self) -> DataFrame:
        """(query_id, question, answer): a user turn and the assistant turn right after it."""
        from ..sources.readers import qa_from_conversations
        return qa_from_conversations(self.conversations)
