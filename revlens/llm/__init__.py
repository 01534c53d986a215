"""Operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this subpackage.
"""
