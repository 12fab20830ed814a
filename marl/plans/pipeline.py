"""Compositions: pages to documents, and questions with documents to packed contexts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean, dedup, dense, fusion, lexical, urls
from ..sources import html
from ..shared import SMALL_ROWS, cut


@dataclass(frozen=True)
class AnswerConfig:
    cleaning: clean.CleanConfig = clean.CleanConfig()
    chunking: clean.ChunkConfig = clean.ChunkConfig()
    bm25: lexical.Bm25Config = lexical.Bm25Config()
    hybrid: fusion.HybridConfig = fusion.HybridConfig()
    retrieved: int = 20
    reranked: int = 4
    budget: int = 12_000
    domains: urls.DomainConfig = field(default_factory=urls.DomainConfig)


class Counters:
    """Counts that a run's own plan takes on its way (Dataset.observe). They are there once the run is over: counts() waits for it."""

    def __init__(self) -> None:
        self.observed: dict[str, Observation] = {}

    def seen(self, rows: DataFrame, stage: str, **counts) -> DataFrame:
        self.observed[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return rows.observe(self.observed[stage], *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()))

    def counts(self) -> dict[str, int]:
        return {n: v for o in self.observed.values() for n, v in o.get.items()}


def ingest_pages(pages: DataFrame, cfg: AnswerConfig = AnswerConfig(), counters: Counters | None = None) -> DataFrame:
    """Allowed pages as documents: cheap URL rules first, then extraction, validation, score and first-copy deduplication.

    pages: (page_id, url, html) and whatever else is known of them, which stays. A column corpus_id says to whose search a page belongs (a
    question's, say): copies are then looked for within a corpus, and a page that several searches found is a document of each.
    counters: takes the counts of the run from its own plan, without another pass."""
    seen = counters.seen if counters else lambda rows, *_, **__: rows
    normal = seen(pages.withColumn("url", urls.normalize_url("url")), "pages", pages=F.count("*"), without_url=F.count_if(F.col("url") == ""))
    allowed = seen(normal.where(urls.is_allowed("url", cfg.domains)), "allowed", allowed=F.count("*"))
    extracted = seen(html.extract_pages(allowed), "extracted", characters=F.sum(F.length("content")), empty=F.count_if(F.col("content") == ""))
    found = cut(seen(extracted.where(text.is_valid_content("content")), "valid", valid=F.count("*")))
    copy = text.sha256_text("content", 1000)
    if "corpus_id" in pages.columns:
        copy = F.concat_ws("|", F.col("corpus_id").cast("string"), copy)
    unique = seen(dedup.first_copies(found, copy, "page_id"), "unique", documents=F.count("*"))
    made = ("page_id", "doc_id", "url", "title", "source_score", "content_hash", "content_length", "content")
    return unique.select(
        "page_id",
        text.document_id("url", "content").alias("doc_id"),
        "url",
        "title",
        urls.credibility("url", cfg.domains).alias("source_score"),
        text.sha256_text("content", 15_000).alias("content_hash"),
        F.length("content").alias("content_length"),
        "content",
        *(f"`{c}`" for c in unique.columns if c not in made),
    )


def chunk_table(documents: DataFrame, cfg: AnswerConfig = AnswerConfig(), column: str = "text") -> DataFrame:
    """Unique chunks of cleaned documents (doc_id of any type, a text column, and whatever else, which stays: url, title and corpus_id among
    it); of equal chunks, within a corpus if there are corpora, the first one of the smallest doc_id stays. ingest_pages gives documents
    whose text is the column content."""
    chunks = clean.chunk_texts(documents, cfg.cleaning, cfg.chunking, column)
    copy = dedup.chunk_hash()
    if "corpus_id" in chunks.columns:
        copy = F.concat_ws("|", F.col("corpus_id").cast("string"), copy)
        # a document may be in several corpora: its chunks are told apart by theirs
        chunks = chunks.withColumn("chunk_id", F.concat_ws("/", F.col("corpus_id").cast("string"), "chunk_id"))
    return cut(dedup.first_copies(chunks, copy, "doc_id", "chunk_index"))


def hits(questions: DataFrame, chunks: DataFrame, cfg: AnswerConfig = AnswerConfig(), strategy: str = "bm25", indexed: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, passage_id, score, rank): the best chunks of each question.

    strategy: "bm25"; "dense", for which questions and chunks have a column embedding; or "hybrid", both fused. Questions and chunks with a
    column corpus_id are searched corpus by corpus, with the statistics of each: a corpus for each question, say. indexed: an index of the
    chunks that was made before (lexical.index, lexical.read_index). vectors: (doc_id, embedding) of documents, which their chunks share, in place
    of the chunks' own: they meet the chunks' numbers only, and no text is exchanged for them."""
    corpus = "corpus_id" if "corpus_id" in chunks.columns else None
    many = cfg.retrieved if strategy != "hybrid" else cfg.hybrid.k * cfg.hybrid.over_fetch
    found = {}
    if strategy in ("bm25", "hybrid"):
        indexed = lexical.index(lexical.passages(chunks, "chunk_id", "chunk_text", corpus)) if indexed is None else indexed
        found["bm25"] = lexical.search(questions, indexed, many, 6, cfg.bm25)
    if strategy in ("dense", "hybrid"):
        known = chunks if vectors is None else chunks.select("doc_id", "chunk_id", *([corpus] if corpus else [])).join(vectors.select("doc_id", "embedding"), "doc_id")
        found["dense"] = dense.search(questions, known, many, "chunk_id", "embedding", "question_id", normalize=True, corpus=corpus)
    if not found:
        raise ValueError(f"no strategy {strategy!r}")
    return fusion.fuse(found["bm25"], found["dense"], cfg.hybrid) if strategy == "hybrid" else found[strategy]


def met(hits: DataFrame, rows: DataFrame, key: str = "passage_id") -> DataFrame:
    """hits (cut, a bounded number for each question) with what rows, wide ones, hold of each: where hits are few (SMALL_ROWS, counted) they go to
    the rows, which are then not exchanged; otherwise the rows come to them."""
    return rows.join(F.broadcast(hits) if hits.count() <= SMALL_ROWS else hits, key)


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: AnswerConfig = AnswerConfig(), strategy: str = "bm25", indexed: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The best chunks of each question with all their columns, reranked by the overlap of their terms with the question's."""
    found = cut(hits(questions, chunks, cfg, strategy, indexed, vectors))
    texts = chunks.drop("embedding").withColumnRenamed("chunk_id", "passage_id")
    clashing = [c for c in texts.columns if c in ("question_id", "question", "score", "rank")]
    joined = met(found, texts.drop(*clashing))
    asked = questions.select("question_id", "question")
    return fusion.rerank(joined.join(asked, "question_id"), lexical.token_overlap("question", "chunk_text"), cfg.reranked)


def answer_context(questions: DataFrame, chunks: DataFrame, cfg: AnswerConfig = AnswerConfig(), strategy: str = "bm25", vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, n_texts, context) of every question that has evidence among the chunks (chunk_table); vectors as for hits."""
    found = retrieve(questions, chunks, cfg, strategy, vectors=vectors)
    packed = fusion.packed_hits(found, "question_id", ["rank"], "chunk_text", cfg.budget)
    return fusion.contexts(packed, "question_id", ["rank"], "chunk_text")


def answer_pages(questions: DataFrame, pages: DataFrame, cfg: AnswerConfig = AnswerConfig(), strategy: str = "bm25") -> DataFrame:
    """(question_id, n_hits, context, sources, fallback) of every question, from pages as they were fetched to the evidence for an answer.

    pages: (page_id, url, html), and with a column corpus_id (the questions have it, too) the search that found each: every question then
    has an index of its own pages, with their statistics. sources: array<struct<rank, title, url, source, type, score>>, the first hit of each
    URL among the evidence. fallback: the fixed answer where there is no evidence, or none that fits the budget."""
    documents = ingest_pages(pages, cfg)
    chunks = chunk_table(documents.select("doc_id", "url", "title", "source_score", "content", *(c for c in ("corpus_id",) if c in documents.columns)), cfg, "content")
    found = cut(retrieve(questions, chunks, cfg, strategy))
    context = fusion.contexts(fusion.packed_hits(found, "question_id", ["rank"], "chunk_text", cfg.budget), "question_id", ["rank"], "chunk_text")
    told = with_fallback(questions.select("question_id"), found, context)
    cited = fusion.citations(found.withColumn("source", urls.host("url")).withColumn("type", F.lit("web")), "question_id", ["rank"], "url")
    return told.join(fusion.sources(cited, "question_id", ("rank", "title", "url", "source", "type")), "question_id", "left")


def collection_report(pages: DataFrame) -> DataFrame:
    """One row of counts over pages with the boolean columns allowed, robots_allowed, cached, fetched and collected: what became of search results."""
    tried = F.col("allowed") & F.col("robots_allowed") & ~F.col("cached")
    return pages.agg(
        F.count_if(F.col("collected") & F.col("fetched") & F.col("allowed") & F.col("robots_allowed")).alias("documents"),
        F.count_if(tried & F.col("fetched")).alias("fetch_success"),
        F.count_if(tried & ~F.col("fetched")).alias("errors"),
        F.count_if(F.col("allowed") & F.col("robots_allowed") & F.col("cached")).alias("cache_hits"),
        F.count_if(~F.col("allowed")).alias("blocked"),
        F.count_if(F.col("allowed") & ~F.col("robots_allowed")).alias("robots_blocked"),
        F.count("*").alias("search_results"),
    )


def final_metadata(pages: DataFrame, query: str = "query", created_at: float | None = None) -> DataFrame:
    """ingested pages with metadata, the struct that documents carry: source, type, score, hash, query, title, length and time."""
    created = F.unix_timestamp().cast("double") if created_at is None else F.lit(created_at)
    return pages.withColumn(
        "metadata",
        F.struct(
            F.col("url").alias("source_url"), F.regexp_extract("url", urls.PARTS, 2).alias("source"), F.lit("web").alias("document_type"), "source_score", "content_hash",
            F.col(query).alias("query"), "title", "content_length", created.alias("created_at"),
        ),
    )


#: Answers without a model: nothing was retrieved, or nothing fitted the context.
NO_EVIDENCE, NO_CONTEXT = "No source with an answer was found.", "The sources found hold no usable text."


def with_fallback(questions: DataFrame, hits: DataFrame, context: DataFrame) -> DataFrame:
    """Every question with its context, or the fixed answer that takes the model's place."""
    found = hits.groupBy("question_id").agg(F.count("*").alias("n_hits"))
    joined = questions.join(found, "question_id", "left").join(context, "question_id", "left")
    fallback = F.when(F.col("n_hits").isNull(), NO_EVIDENCE).when(F.coalesce("context", F.lit("")) == "", NO_CONTEXT)
    return joined.select("question_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("context", F.lit("")).alias("context"), fallback.alias("fallback"))


def payload(question: str, context: str, system: str, model: str = "model", temperature: float = 0.15, tokens: int = 1200):
    """A chat request as JSON."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.concat(F.lit("Context:\n"), F.coalesce(F.col(context), F.lit("")), F.lit("\n\nQuestion:\n"), F.col(question))
    whole = F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.lit(tokens).alias("max_tokens"), F.array(message("system", F.lit(system)), message("user", asked)).alias("messages"))
    return F.to_json(whole)
