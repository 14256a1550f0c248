"""A PySpark-native engine for coding-agent session analytics and training-data work."""
