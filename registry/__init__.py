"""The registered queries and, beside them, the SQL that gives the same rows."""
