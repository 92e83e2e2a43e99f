"""Operators for training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` registers the production query of each.
"""
