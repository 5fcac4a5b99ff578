"""Operators of a training-data pipeline: thirteen operators, their registered queries and SQL counterparts."""
