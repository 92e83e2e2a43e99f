"""Readers: Hive datasets with drifting schemas, logs, and paged or streamed feeds."""
