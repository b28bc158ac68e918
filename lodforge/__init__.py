"""Spark-native level-of-detail engine for survey point clouds and their viewing telemetry."""
