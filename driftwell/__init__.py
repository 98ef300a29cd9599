"""Spark-native relational and change-log engine."""
