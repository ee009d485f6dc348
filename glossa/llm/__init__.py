"""Training-data operators (mixing, dedup, scoring, filters, packing).

Nothing outside this folder imports it. Every operator module documents its
method, parameters and edge cases; ``queries.py`` holds the thin registered
queries and ``oracle.py`` their DuckDB SQL where SQL can express them.
"""
