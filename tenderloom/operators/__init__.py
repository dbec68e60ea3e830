"""Procurement analytics operators on DataFrames."""
