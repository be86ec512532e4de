"""A Spark-native engine for demultiplexing and trimming barcoded reads, and for preparing text corpora."""
