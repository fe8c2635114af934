"""Training-data operators on Spark: extraction, filtering, deduplication, encoding, search.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
