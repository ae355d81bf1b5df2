"""Sinks: load files in load order, as SQL statements, COPY blocks, JSON lines or Parquet."""
