"""Gridded imagery, class maps and text corpora as Spark DataFrames.

Operators are functions from DataFrame to DataFrame; ``gridloom.plans`` holds
named queries over them with their SQL equivalents.
"""
