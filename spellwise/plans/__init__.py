"""The query catalogue: each query with the SQL that gives the same rows."""
