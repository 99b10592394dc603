"""Spark-native velocity and image mosaicking: sources, column functions, operators, plans and streams."""
