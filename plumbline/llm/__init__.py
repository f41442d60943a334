"""Training-data operators: tokenising, extraction, packing, deduplication and scans.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
