"""Operators for preparing training data: one module for each operator, each with its query."""
