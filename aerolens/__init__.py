"""Airwave analytics on Spark: DataFrame operators for wireless capture data."""
