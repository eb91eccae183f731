"""Training-data operators: dedup, fingerprints, filters, tokenising, extraction, models.

Nothing else in the library imports this package. Queries over the given tables are in
``seqtok.llm.queries``, their DuckDB twins in ``seqtok.llm.oracle``.
"""
