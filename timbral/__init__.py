"""A PySpark-native engine for audio-sample libraries."""
