"""Skyloom: PySpark-native analytics for periodic 3-D point catalogues."""
