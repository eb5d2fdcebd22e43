"""Training-data operators: near-duplicates, fingerprints, repeated passages,
quality, secrets, toxicity, mixing, decontamination, chat formatting, WARC.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
