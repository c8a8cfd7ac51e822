"""Whole plans: the mapping pipeline and the registered queries."""
