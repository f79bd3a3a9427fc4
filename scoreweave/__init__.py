"""Sparse entity x item score tables on Spark: ingest, resolve, hold out, predict, explain, evaluate."""
