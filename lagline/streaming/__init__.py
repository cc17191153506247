"""Stateful and windowed forms for live streams."""
