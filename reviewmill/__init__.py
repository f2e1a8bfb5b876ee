"""Review analytics as Spark DataFrame jobs.

functions/  column expressions          sources/    scans, header mapping, sinks
operators/  dedup, numbering, search    plans/      standardize, reports, evaluation, jobs
streaming/  file intake and upserts     catalog/    registered queries with their SQL twins
"""
