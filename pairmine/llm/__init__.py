"""Training-data operators: near-duplicates, licences, quality, toxicity, nearest
neighbours, mixing, packing, personal data and exact substring dedup.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and ``oracle.py`` their DuckDB SQL.
"""
