"""jangbu: document-analytics operators as lazy Spark DataFrames.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (joins, aggregations, windows, data repair),
``plans`` (typed query plans and their execution), ``streaming`` (Structured
Streaming twins) and the optional ``llm`` package, which nothing here imports.
"""
