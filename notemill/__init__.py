"""notemill: PySpark-native mining of computational notebooks and text corpora."""
