"""Spark-first analytics engine for building and evaluating labelled spatial-relation datasets."""
