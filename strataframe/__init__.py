"""A PySpark-native engine for price panels, trial logs and training corpora."""
