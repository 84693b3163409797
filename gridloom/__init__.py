"""gridloom: Spark-native analytics over gridded, point and line tables."""
