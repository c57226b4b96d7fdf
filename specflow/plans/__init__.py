"""Composite jobs built from operators (training, scoring, outliers, ordering)."""
