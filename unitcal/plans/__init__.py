"""Worked queries on the star-schema tables, each with its SQL counterpart."""
