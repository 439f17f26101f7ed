"""Broadcast-multiplex analytics and training-data preparation on PySpark DataFrames."""
