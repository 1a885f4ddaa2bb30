"""Declarative steps of each tool: what to choose before it runs. Static configuration for front ends."""

from __future__ import annotations

# --- Fixed values: tools, their steps and options. ---
FLOWS = {
    "duplicates": [("columns", "Which columns make two rows the same?", "columns"), ("confusion", "Columns that make poor keys", "check")],
    "dedupe": [("columns", "Which columns make two rows the same?", "columns"), ("confusion", "Columns that make poor keys", "check"), ("keep", "Which row of a group stays?", ["first", "last", "complete"])],
    "outliers": [("columns", "Which numbers?", "columns"), ("evaluate", "Spread and skew of each", "check"), ("method", "How are outliers told?", ["iqr", "zscore"]), ("how", "What happens to them?", ["keep", "cap", "remove"])],
    "match": [("files", "Which tables?", "files"), ("key", "Shared key", "column"), ("how", "Which rows stay?", ["outer", "inner", "left", "right"])],
    "validate": [("required", "Required columns", "columns"), ("rules", "Checks", ["required", "email", "phone", "range"])],
    "summarise": [("columns", "Which columns?", "columns")],
    "compare": [("files", "Old and new table", "files"), ("key", "Key", "column")],
    "combine": [("files", "Which tables?", "files")],
    "anonymise": [("columns", "Which columns?", "columns"), ("how", "How?", ["hash", "mask", "drop"])],
    "quick_clean": [("confirm", "Clean all columns by their types", "confirm")],
    "guess_gender": [("column", "Column of names", "column"), ("confirm", "An estimate, not a fact", "confirm")],
}
# --- End of fixed values. ---


def flow(tool: str) -> list[dict]:
    """The ordered steps of a tool; an unknown one has a single confirmation."""
    return [{"id": i, "title": t, "options": o} for i, t, o in FLOWS.get(tool, [("confirm", "Run", "confirm")])]
