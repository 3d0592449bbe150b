"""Column expressions: missing-like values, coercion, text, rounding."""
