"""Training-data operators: quality, scoring, tokens, sharding, dedup, mixing, extraction.

One module per operator, each with a general interface over DataFrames; the
thin ``opN_*`` queries over the given tables are in ``queries``, their DuckDB
statements in ``oracle``. Nothing else in the library imports this subpackage.
"""
