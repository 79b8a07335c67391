"""Operations of a large training-data pipeline.

Ten operators, each in a module of its own, plus the queries that apply them
to whole tables (``llm_queries``).  Nothing outside this folder imports it.
"""
