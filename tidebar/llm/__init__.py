"""Training-data operators: deduplication, quality, language, tokens, shards and packing.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
