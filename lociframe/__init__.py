"""Genomic evidence ranking and single-cell expression analytics as Spark DataFrame operators."""
