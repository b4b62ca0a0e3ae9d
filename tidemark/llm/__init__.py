"""Operators for preparing training data: scoring, deduplication, decontamination,
personal data, URL rules, token counts, mixing and sharding.

Nothing outside this package imports it; general helpers (session, table
reading) are imported from the rest of the library.
"""
