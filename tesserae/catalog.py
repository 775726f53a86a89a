"""All queries of the engine's own operators, and their SQL."""

from tesserae.queries import base, languages, reports, tokens, sequences, vocabularies  # noqa: F401

QUERIES, SQL = base.QUERIES, base.SQL
