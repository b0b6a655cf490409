"""quarry: a PySpark-native relational, JSON and vector engine."""
