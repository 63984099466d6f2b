"""Evidence corpora, retrieval and evaluation as Spark DataFrame transformations."""
