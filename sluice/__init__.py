"""A Spark-first curation engine: prune, score, publish, review and evaluate large item streams."""
