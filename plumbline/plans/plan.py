"""Cleaning plans: ordered mappings of a source column to a target field by a transform.

A plan becomes two projections: the source columns cleaned, and one struct <value, flagged, reason>
for each mapping. Catalyst sees plain expressions, so columns that nobody reads are pruned, and
the same plan runs on a stream. The report is one aggregation over that table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.functions.values import Let
from plumbline.operators import transforms as T

#: Transforms that look at a whole column before they can decide a value.
WHOLE_COLUMN = ("resolve", "auto_categorical", "induce_vocabulary")
EXAMPLES, FLAGS = 5, 50


@dataclass
class Mapping:
    source_column: str
    target_field: str
    transform: str
    params: dict = field(default_factory=dict)


@dataclass
class Plan:
    mappings: list[Mapping]
    name: str = "plan"

    @staticmethod
    def of(plan: Plan | dict | str | Path) -> Plan:
        """A plan as it is, from its dict form, or from a JSON file."""
        if isinstance(plan, Plan):
            return plan
        if not isinstance(plan, dict):
            plan = json.loads(Path(plan).read_text(encoding="utf-8"))
        return Plan([Mapping(m["source_column"], m["target_field"], m["transform"], {k: v for k, v in (m.get("params") or {}).items() if k != "pivot"}) for m in plan["mappings"]], plan.get("name", "plan"))

    def to_dict(self) -> dict:
        return {"name": self.name, "mappings": [vars(m) for m in self.mappings]}


@dataclass
class Run:
    """The result of a plan: `table` is lazy, and so is all that is derived from it."""

    plan: Plan
    raw: DataFrame
    staged: DataFrame  # the source columns and one struct _t{i} for each mapping done
    done: list[int]
    missing: list[str]  # source columns that the table doesn't have

    @property
    def table(self) -> DataFrame:
        """Target fields in plan order, then untouched columns, then `flagged`."""
        m = self.plan.mappings
        made = {m[i].target_field: F.col(f"_t{i}.value").alias(m[i].target_field) for i in self.done}
        used = {m[i].source_column for i in self.done}
        kept = [F.col(f"`{c}`") for c in self.raw.columns if c not in used and c not in made]
        return self.staged.select(*made.values(), *kept, self._any_flag().alias("flagged"))

    def _any_flag(self) -> Column:
        out = F.lit(False)
        for i in self.done:
            out = out | F.col(f"_t{i}.flagged")
        return out

    @property
    def flagged(self) -> DataFrame:
        """Rows with a flag, with the reasons as `column: reason` joined by `; `."""
        m = self.plan.mappings
        reasons = F.concat_ws("; ", *[F.when(F.col(f"_t{i}.flagged"), F.concat(F.lit(f"{m[i].target_field}: "), F.col(f"_t{i}.reason"))) for i in self.done])
        made = {m[i].target_field: F.col(f"_t{i}.value").alias(m[i].target_field) for i in self.done}
        used = {m[i].source_column for i in self.done}
        kept = [F.col(f"`{c}`") for c in self.raw.columns if c not in used and c not in made]
        return self.staged.where(self._any_flag()).select(*made.values(), *kept, reasons.alias("reasons"))

    def counts(self) -> DataFrame:
        """(target_field, source_column, transform, rows, changed, flagged), by one aggregation."""
        m = self.plan.mappings
        each = []
        for i in self.done:
            before, t = X.string(f"`{m[i].source_column}`"), F.col(f"_t{i}")
            each.append(F.struct(F.count("*").alias("rows"), F.sum((t["value"] != before).cast("long")).alias("changed"), F.sum(t["flagged"].cast("long")).alias("flagged")).alias(f"c{i}"))
        if not each:
            return self.raw.sparkSession.createDataFrame([], "target_field string, source_column string, transform string, rows long, changed long, flagged long")
        one = self.staged.agg(*each)
        rows = F.array(*[F.struct(F.lit(m[i].target_field).alias("target_field"), F.lit(m[i].source_column).alias("source_column"), F.lit(m[i].transform).alias("transform"), F.col(f"c{i}.rows").alias("rows"), F.coalesce(F.col(f"c{i}.changed"), F.lit(0)).alias("changed"), F.coalesce(F.col(f"c{i}.flagged"), F.lit(0)).alias("flagged")) for i in self.done])
        return one.select(F.inline(rows))

    def changes(self) -> DataFrame:
        """Every changed or flagged value: (column, before, after, flagged, reason)."""
        m = self.plan.mappings
        rows = F.array(*[F.struct(F.lit(m[i].target_field).alias("column"), X.string(f"`{m[i].source_column}`").alias("before"), F.col(f"_t{i}.value").alias("after"), F.col(f"_t{i}.flagged").alias("flagged"), F.col(f"_t{i}.reason").alias("reason")) for i in self.done])
        return self.staged.select(F.inline(rows)).where("flagged or before <> after")

    def report(self) -> dict:
        """The audit: counts for each column with a few examples and flags, and what was missing."""
        out = {"plan": self.plan.name, "columns": [r.asDict() for r in self.counts().collect()], "errors": [{"source_column": c, "error": "column not in the table"} for c in self.missing]}
        if self.done:
            said = self.changes().select("column", F.inline(F.array(
                F.struct(F.lit("change").alias("what"), (F.col("before") != F.col("after")).alias("is"), "before", F.col("after").alias("also")),
                F.struct(F.lit("flag").alias("what"), F.col("flagged").alias("is"), "before", F.col("reason").alias("also")),
            ))).where("is").select("column", "what", "before", "also").distinct()
            place = F.row_number().over(Window.partitionBy("column", "what").orderBy("before", "also"))  # of which the least are kept before the shuffle
            said = said.withColumn("place", place).where(F.col("place") <= F.when(F.col("what") == "flag", FLAGS).otherwise(EXAMPLES))
            few = said.groupBy("column").agg(
                F.collect_list(F.when(F.col("what") == "change", F.struct("before", F.col("also").alias("after")))).alias("examples"),
                F.collect_list(F.when(F.col("what") == "flag", F.struct(F.col("before").alias("value"), F.col("also").alias("reason")))).alias("flags"),
            )
            shown = {r["column"]: r for r in few.collect()}
            for c in out["columns"]:
                r = shown.get(c["target_field"])
                c["examples"] = [x.asDict() for x in r["examples"]] if r else []
                c["flags"] = [x.asDict() for x in r["flags"]] if r else []
        return out


def staged(df: DataFrame, build: Callable[[Let], dict[str, Column]]) -> DataFrame:
    """Adds the columns that `build` makes; what it passes to `let` is computed once, as a column that goes again."""
    steps: list[tuple[str, Column]] = []

    def let(c: Column) -> Column:
        steps.append((f"__l{len(steps)}", c))
        return F.col(steps[-1][0])

    made = build(let)
    for name, c in steps:
        df = df.withColumn(name, c)
    return df.withColumns(made).drop(*[name for name, _ in steps])


def run_plan(df: DataFrame, plan: Plan | dict | str) -> Run:
    """Applies a plan. A mapping whose source column is missing is skipped and reported."""
    plan = Plan.of(plan)
    has = set(df.columns)
    done, missing = [], []
    for i, m in enumerate(plan.mappings):
        (done.append(i) if m.source_column in has else missing.append(m.source_column))
    cleaned = {f"_s{i}": X.clean(f"`{plan.mappings[i].source_column}`") for i in done}
    staged = df.withColumns(cleaned) if cleaned else df
    steps: list[dict[str, Column]] = []  # intermediate columns of all mappings, one projection for each depth
    made = {}
    for i in done:
        m = plan.mappings[i]
        if m.transform in WHOLE_COLUMN:
            continue
        own: list[str] = []

        def let(c: Column, i: int = i, own: list[str] = own) -> Column:
            own.append(f"_l{i}_{len(own)}")
            if len(steps) < len(own):
                steps.append({})
            steps[len(own) - 1][own[-1]] = c
            return F.col(own[-1])

        made[f"_t{i}"] = T.pack(T.get_transform(m.transform)(X.string(f"`{m.source_column}`"), F.col(f"_s{i}"), let, **m.params))
    for step in steps:
        staged = staged.withColumns(step)
    staged = staged.withColumns(made) if made else staged
    staged = staged.drop(*[name for step in steps for name in step])
    for i in done:
        m = plan.mappings[i]
        if m.transform == "resolve":
            from plumbline.operators.resolve import resolve_column

            staged = resolve_column(staged, m.source_column, f"_t{i}", source=df, **m.params)
        elif m.transform in WHOLE_COLUMN:
            from plumbline.operators.vocabulary import categorical_column

            staged = categorical_column(staged, m.source_column, f"_t{i}", source=df)
    return Run(plan, df, staged.drop(*cleaned), done, missing)


def clean_file(spark, path: str, plan: Plan | dict | str) -> Run:
    """Reads a file with all columns as text and applies a plan."""
    from plumbline.sources.router import read_any

    return run_plan(read_any(spark, path)[0], plan)
