"""Versions that arrive over time; an extension beside the batch operators."""
