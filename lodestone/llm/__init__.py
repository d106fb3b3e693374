"""Operators for large training-data pipelines, with their queries and SQL in `lodestone.llm.queries`."""
