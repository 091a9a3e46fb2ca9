"""Leakage-aware feature selection as Spark DataFrame operators."""
