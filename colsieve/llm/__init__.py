"""Operators of a training-data pipeline. Nothing outside this folder imports it, but for the registry in __spark_entry__."""
