"""Queries over the driver's tables, each with the same rows in DuckDB SQL."""
