"""The registered queries: raw transactions derived from the given tables, and their SQL counterparts."""
