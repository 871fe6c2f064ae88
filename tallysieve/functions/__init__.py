"""Scalar functions on columns: names, urls, salaries, places, times and title features."""
