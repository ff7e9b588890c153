"""URL risk analytics on PySpark: score, match, train and report over URL tables."""
