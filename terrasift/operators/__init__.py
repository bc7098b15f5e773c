"""Operators: guarded execution, catalog, joins, logs, history, stores and migrations."""
