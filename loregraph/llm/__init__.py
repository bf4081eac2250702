"""Training-data operators: encoding, packing, sharding, scoring, deduplication,
language identification, token counts, similarity joins and decontamination.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()``
live in :mod:`loregraph.llm.registry`.
"""
