"""Scalar functions from Column to Column."""
