"""Spark jobs for preparing and judging preference-aware reasoning data."""
