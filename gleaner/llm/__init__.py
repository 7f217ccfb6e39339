"""Training-data operators: archives, deduplication, filters, packing, scoring.

Nothing outside this folder and ``corpus_pipeline.py`` imports it."""
