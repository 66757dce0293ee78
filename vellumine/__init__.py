"""A PySpark-native engine for document corpora and their catalogues."""
