"""Typed-decision and calibration analytics on PySpark DataFrames."""
