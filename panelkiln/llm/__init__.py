"""Training-data operators: quality, dedup, language model, packing, scans, tokens, media.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is there.
"""
