"""Event-stream analytics on Spark: ordering, time joins, windows, estimators, geometry and reports."""
