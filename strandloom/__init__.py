"""Spark-first engine for linkage graphs of genomic sequences."""
