"""All queries of the table checks, and their SQL."""

from gridcheck.queries import columns, references, slots_tokens, streams_sources

_ALL = (columns.R, references.R, slots_tokens.R, streams_sources.R)
QUERIES = {name: fn for r in _ALL for name, fn in r.queries.items()}
ORACLES = {name: sql for r in _ALL for name, sql in r.sql.items()}
