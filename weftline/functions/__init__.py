"""Column expressions and small task-side helpers."""
