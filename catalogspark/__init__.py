"""A PySpark engine for product-catalogue data: ingest, normalise, derive, audit, match, score, relate, learn, export.

operators/  jobs, DataFrame in and DataFrame out
sources/    readers and writers
functions/  Column expressions and session helpers
plans/      registered queries and their SQL twins
streaming/  incremental forms of the batch jobs
"""
