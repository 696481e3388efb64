"""Column expressions: grading, text, time and score functions."""
