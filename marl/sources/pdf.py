"""PDF documents. Decoding a file is left to whatever fills the column of page texts; this is what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import urls


def extract_pdfs(files: DataFrame, pages: str = "pages", url: str = "url", cfg: urls.DomainConfig = urls.DomainConfig()) -> DataFrame:
    """files with content, document_type, source_score and content_hash. pages: array<string>, the text of each page; null for a file that
    could not be decoded, whose content is empty and which has no hash."""
    kept = F.filter(pages, lambda p: p.isNotNull() & (p != ""))
    content = F.coalesce(text.squeeze(F.array_join(kept, "\n")), F.lit(""))
    found = files.withColumn("content", content).withColumn("document_type", F.lit("pdf")).withColumn("source_score", urls.credibility(url, cfg))
    return found.withColumn("content_hash", F.when(F.col("content") != "", text.sha256_text("content", 15_000))).drop(pages)
