"""strandline: Spark-native analytics over append-only agent-session logs."""
