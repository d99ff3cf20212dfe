"""Training-data operators: packing, near-duplicate joins, filters, sharding, search, tokens.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
