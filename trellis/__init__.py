"""trellis: a PySpark-native analytics engine for knowledge bases queried through several views."""
