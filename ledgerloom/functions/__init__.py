"""Column functions: text, amounts, dates and times, validation."""
