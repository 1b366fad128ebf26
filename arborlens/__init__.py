"""Spark-first structural analytics over source trees, their edit history and the texts around them."""
