"""Graphs over the supplied tables, the registered queries on them, and their SQL counterparts."""
