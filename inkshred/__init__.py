"""inkshred: a Spark engine for corpora of word-processing documents."""
