"""Training-data operators: quality, toxicity, deduplication, decontamination, tokenising, chat and WARC."""
