"""kinforge: a PySpark-native record-linkage and entity-resolution engine."""

__version__ = "0.1.0"
