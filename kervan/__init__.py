"""kervan: retrieval-augmented question answering and its evaluation as lazy Spark plans."""
