"""Operators over impression, scored and run tables."""
