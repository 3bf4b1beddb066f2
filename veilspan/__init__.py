"""veilspan: a Spark-native engine that finds, masks, restores and measures sensitive text spans."""
