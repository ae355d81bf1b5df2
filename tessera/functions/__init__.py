"""Masks as columns."""
