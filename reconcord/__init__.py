"""Spark-first payment reconciliation and corpus preparation."""
