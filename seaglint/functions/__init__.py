"""Column functions: ``fn(col, ...) -> Column``; no Python runs per row."""
