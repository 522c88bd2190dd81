"""tidewatch: PySpark operators for data operations (run logs, usage, quality, lineage)."""
