"""Operators on graphs and tables, each a function of DataFrames."""
