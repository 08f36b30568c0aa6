"""Column, window, calendar and as-of helpers."""
