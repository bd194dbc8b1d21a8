"""Spark-native document extraction, evaluation and corpus analytics."""
