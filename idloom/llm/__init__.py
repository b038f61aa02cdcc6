"""Training-data operators: deduplication, packing, mixing, filtering, formatting and token output.

Nothing outside this subpackage imports it; ``idloom.llm.entry`` lists its queries and SQL.
"""
