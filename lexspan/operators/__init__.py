"""Transformations of DataFrames: matching, joins on spans, hierarchy, search, reconciliation."""
