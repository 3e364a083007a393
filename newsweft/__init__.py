"""Spark-native analytics for company-news data: record functions, relational queries, state folds and archive output."""
