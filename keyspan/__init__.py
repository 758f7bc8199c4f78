"""keyspan: a PySpark engine for data partitioned by ranges of a 64-bit keyspace."""
