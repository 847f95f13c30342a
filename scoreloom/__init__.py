"""scoreloom: a PySpark-native engine for scored inventory snapshots and the judgments made about them."""
