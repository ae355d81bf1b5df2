"""A Spark-native engine for referential subsetting and masking of relational and document data."""
