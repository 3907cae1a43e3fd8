"""Intentionally empty: the inventory has no streams, event times or watermarks.

Data arrives as finished files, and a batch append with a commit row covers it.
"""
