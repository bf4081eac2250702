"""Column functions: text, dates, values."""
