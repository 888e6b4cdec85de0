"""Registered queries: each module has QUERIES, and ORACLES with the same in DuckDB SQL."""
