"""Spark-native document forensics: what a machine reads and a person does not see."""
