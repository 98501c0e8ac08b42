"""Training-data operators: near-duplicates, tokens, quality, mixing, archives, URLs, nearest neighbours.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
