"""Spark-native compression and validation of calorimeter energy-deposit steps."""
