"""Product-quality analytics on Spark: profiling, duplicate groups, folds, image similarity, text rules and fold-safe models."""
