"""Relational operators on postings: gates, verdict rules, deduplication, entity resolution, views and state."""
