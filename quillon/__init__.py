"""Ranking and recall over event logs on Spark; training-data operators live in the llm subpackage."""
