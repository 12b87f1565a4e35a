"""A PySpark-native analytics engine for versioned technical catalogues."""
