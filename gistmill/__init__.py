"""Budgeted-context analytics on Spark: chunking, ranking, pruning, packing, evaluation and prompt search as DataFrame operators."""
