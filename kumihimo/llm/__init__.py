"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each operator has a general
function of DataFrames and a thin ``opN_<name>(spark, sf_dir)`` query.
"""
