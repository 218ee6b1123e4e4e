"""Workflow graphs in Python source, as DataFrames."""
