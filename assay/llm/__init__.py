"""Training-data operators on Spark DataFrames.

One module per operator; ``queries`` holds the thin contract queries.  Nothing outside this
subpackage imports it.
"""
