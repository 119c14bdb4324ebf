"""Registered queries, their SQL counterparts and the comparison between the two."""
