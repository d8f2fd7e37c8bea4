"""objectlake: schemaless object collections on Spark.

Objects live in classes within projects, carry server-assigned ids, and are
kept as immutable Parquet generations plus an ordered change log.
"""
