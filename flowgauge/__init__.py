"""flowgauge: a Spark-native analytics engine for event streams of AI coding sessions."""
