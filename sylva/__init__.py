"""sylva: a PySpark-native engine for crown and object-detection analytics."""
