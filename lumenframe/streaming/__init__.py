"""Recorded inference and detection results, as tables and as streams."""
