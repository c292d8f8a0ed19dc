"""Stratum: a PySpark-native range-and-join analytics engine over fixed-width string relations."""
