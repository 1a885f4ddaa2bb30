"""The table tools by name: tables in, (table, summary) out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import duplicates, joins, names, outliers, quality
from plumbline.operators.profile import profile, profile_to_plan
from plumbline.plans.plan import run_plan
from plumbline.plans.shared import spread

Result = tuple[DataFrame, dict]


def _outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", how: str = "list") -> Result:
    columns = columns or [p.column for p in profile(df, gazetteer=False) if p.semantic_type == "numeric"]
    if how == "list":
        out = outliers.find_outliers(df, columns, method) if columns else df.limit(0)
        return out, {"outliers": out.count(), "numeric_columns_checked": len(columns)}
    for c in columns:
        df = outliers.treat(df, c, how, method)
    return df, {"numeric_columns_treated": len(columns), "how": how, "method": method}


def _match(dfs: list[DataFrame], how: str = "outer", key: str | None = None) -> Result:
    keys = joins.detect_key(dfs) if key is None else [key] * len(dfs)
    out = joins.match(dfs, how, keys)
    return out, {"files": len(dfs), "key_detected": keys[0], "join": how, "rows": out.count()}


def _validate(df: DataFrame, rules: list[quality.Rule] | None = None, required: list[str] | None = None, row: list[str] | None = None) -> Result:
    rules = rules if rules is not None else quality.rules_for(df, required)
    out = quality.validate(df, rules, row or df.columns[:1])
    return out, {"issues": out.count(), "rows_checked": df.count(), "columns_checked": len({r.column for r in rules})}


def _summarise(df: DataFrame, **options) -> Result:
    return quality.summarise(df, types=True, **options), {"rows": df.count(), "columns": len(df.columns)}


def _compare(dfs: list[DataFrame], key: str | None = None) -> Result:
    if len(dfs) != 2:
        raise ValueError("Compare needs exactly two tables (old, new).")
    out = joins.compare(*dfs, key=key)
    return out, joins.compare_summary(out)


def _combine(dfs: list[DataFrame]) -> Result:
    out = joins.combine(dfs)
    return out, {"files": len(dfs), "rows": out.count(), "columns": len(out.columns) - 1}


def quick_clean(df: DataFrame) -> Result:
    """Every column cleaned by its type."""
    df = spread(df)
    run = run_plan(df, profile_to_plan(profile(df)))
    rows, changed = run.counts().agg(F.max("rows"), F.coalesce(F.sum("changed"), F.lit(0))).first()
    return run.table, {"columns": len(df.columns), "rows": df.count() if rows is None else rows, "values_changed": changed}


#: Tool: (title, what it makes, whether it takes several tables, function).
TOOLS: dict[str, tuple[str, str, bool, Callable[..., Result]]] = {
    "duplicates": ("Find duplicates", "dataset", False, duplicates.find_duplicates),
    "outliers": ("Find outliers", "report", False, _outliers),
    "match": ("Match & merge tables", "dataset", True, _match),
    "validate": ("Validate data", "report", False, _validate),
    "summarise": ("Summarise", "report", False, _summarise),
    "dedupe": ("Remove duplicates", "dataset", False, duplicates.dedupe_file),
    "compare": ("Compare two tables", "report", True, _compare),
    "combine": ("Combine tables", "dataset", True, _combine),
    "anonymise": ("Anonymise", "dataset", False, quality.anonymise),
    "quick_clean": ("Quick clean", "dataset", False, quick_clean),
    "guess_gender": ("Estimate gender from name", "dataset", False, lambda df, names_table=None, column=None: names.guess_gender(df, names_table, column)),
}


def run(tool: str, tables: DataFrame | list[DataFrame], **options) -> Result:
    """Runs a tool by name."""
    if tool not in TOOLS:
        raise KeyError(f"Unknown tool '{tool}'. Known: {', '.join(sorted(TOOLS))}")
    *_, several, f = TOOLS[tool]
    tables = tables if isinstance(tables, list) else [tables]
    return f(tables, **options) if several else f(tables[0], **options)
