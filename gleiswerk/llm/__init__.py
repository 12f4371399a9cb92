"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``llm.registry`` names
its queries and their SQL.
"""
