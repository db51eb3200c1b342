"""revlens: code-review analytics on Spark.

Batch and Structured Streaming jobs over tables of webhook deliveries, diff
files, source text, review findings, conventions, embeddings and feedback.

Layout
------
sources/    table readers, derived fixture tables, delivery / diff / store sources, sinks
functions/  pure Column expressions (text, hashing, vectors, lookups) and the UDF surface
operators/  DataFrame -> DataFrame operators (metrics, routing, diffs, kNN, intervals, ...)
plans/      composed pipelines (delivery -> stored review, gold metric tables)
streaming/  Structured Streaming jobs (ingest, dedupe, running metrics, upserts)
"""

__all__ = ["session"]
