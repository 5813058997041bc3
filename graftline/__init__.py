"""graftline: a PySpark-native engine for weighted directed graphs, label transfer and sliced reports."""
