"""A Spark-native analytics library: the query surface of a PostgreSQL-flavoured database over DataFrames."""
