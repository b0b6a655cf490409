"""Training-data operators: dedup, tokenisation, scans, scoring, packing, sharding and search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries if it is present.
"""
