"""Logical plans: which rows of each table an extraction keeps. Nothing here needs a Spark session."""
