"""Named queries: compositions of operators over the tables, and their SQL counterparts."""
