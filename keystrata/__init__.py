"""Keystrata: keyed tables for Spark, kept as append-only change logs."""
