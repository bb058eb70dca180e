"""The registered queries and their SQL counterparts, by theme."""
