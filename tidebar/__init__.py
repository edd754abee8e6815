"""A PySpark-native engine for strategy analytics over OHLCV bars."""
