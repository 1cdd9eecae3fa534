"""lodestar: a Spark-native engine for evaluating, curating, serving and monitoring text-to-SQL data."""
