"""Retrieval plans, the question-to-SQL pipeline, and the registered queries."""
