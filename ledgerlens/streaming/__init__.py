"""Project events: validation, dedupe, state folds; the same functions serve tables and streams."""
