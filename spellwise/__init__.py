"""Longitudinal employment analytics and training-data operators on PySpark."""
