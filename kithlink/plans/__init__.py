"""Composed runs over the given tables, the query list and its reference SQL."""
