"""A PySpark-native engine for evidence-driven data processing."""
