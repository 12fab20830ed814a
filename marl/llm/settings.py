"""Production parameters that queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .toxicity import ToxicityConfig, ToxicityModel, fit, labelled_sample

#: Modulus and remainder (of crc32 of doc_id as text) of the held-out documents.
TOXIC_FOLD, QUALITY_FOLD = (5, 0), (3, 1)


def toxicity_model(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    cfg = ToxicityConfig()
    return fit(labelled_sample(documents, labels, "toxic", *TOXIC_FOLD, cfg.sample), cfg)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
