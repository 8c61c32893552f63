"""Declarative ETL and analytics pipelines compiled to Spark DataFrames."""
