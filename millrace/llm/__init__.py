"""Operators for preparing training data: counting, cleaning, matching, splitting and packing texts."""
