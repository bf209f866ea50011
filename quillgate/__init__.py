"""Preference-data and evaluation pipelines as Spark DataFrame operators."""
