"""Whole jobs: the batch build of the lake and the registered queries."""
