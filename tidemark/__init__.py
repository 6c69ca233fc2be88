"""Data-popularity analytics on PySpark: working sets, recalls and transfer locality."""
