"""recollex: a PySpark-native engine for building, checking and scoring memory-retrieval benchmarks."""
