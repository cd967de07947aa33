"""vigil: Spark-native incident analytics, retrieval and stream correlation."""
