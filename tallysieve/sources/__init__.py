"""Readers that turn landed files of several shapes into listings."""
