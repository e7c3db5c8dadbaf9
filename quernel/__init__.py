"""A Spark-native analytics engine: a compact SQL surface, vector search, logs and versions, statistics and monitoring over DataFrames."""
