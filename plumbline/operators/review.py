"""Review of a run: what changed in each column, spot checks, decisions applied, and their ledger."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators import duplicates as D
from plumbline.plans.plan import Plan, Run, run_plan

MOST_DISTINCT, EXAMPLES = 800, 6


def differs(a: Column, b: Column) -> Column:
    return X.string(a) != X.string(b)


def changed_values(run: Run) -> DataFrame:
    """(column, before, after, count) of the distinct changes."""
    return run.changes().where("before <> after").groupBy("column", "before", "after").agg(F.count("*").alias("count"))


def column_overview(run: Run, most: int = MOST_DISTINCT) -> DataFrame:
    """(column, before, after, count, rank): up to `most` distinct changes of each column, most frequent first."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "before", "after")  # keeps `most` rows a partition before the shuffle
    return changed_values(run).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def spotcheck(run: Run, n: int = 20, seed: int = 1) -> DataFrame:
    """n rows drawn by a seeded hash: for each mapping the value before and after and whether it changed."""
    m = run.plan.mappings
    cols = []
    for i in run.done:
        t, before = m[i].target_field, X.string(f"`{m[i].source_column}`")
        cols += [before.alias(f"{t}_before"), F.col(f"_t{i}.value").alias(f"{t}_after"), (before != F.col(f"_t{i}.value")).alias(f"{t}_changed")]
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in run.raw.columns])
    return run.staged.orderBy(key, *[F.col(f"`{c}`").cast("string") for c in run.raw.columns]).limit(n).select(*cols)


def set_all(df: DataFrame, column: str, value: str) -> tuple[DataFrame, int]:
    """The column overwritten, and how many values that changes."""
    return df.withColumn(column, F.lit(value)), df.where(differs(F.col(f"`{column}`"), F.lit(value))).count()


def merge_spellings(df: DataFrame, column: str, members: list[str], into: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.withColumn(column, F.when(c.cast("string").isin(*members), F.lit(into)).otherwise(c))


@dataclass
class Decisions:
    """What a reviewer decided: columns whose cleaning is rejected, columns set to a value,
    spellings merged ({column: [{into, members}]}), and whether duplicates go."""

    reject: list[str] = field(default_factory=list)
    set_all: dict[str, str] = field(default_factory=dict)
    merges: dict[str, list[dict]] = field(default_factory=dict)
    remove_duplicates: bool = False
    order: list[str] | None = None


def apply_decisions(df: DataFrame, plan: Plan | dict, decisions: Decisions) -> tuple[DataFrame, list[dict]]:
    """The cleaned table after the decisions, and an audit of them."""
    plan = Plan.of(plan)
    kept = Plan([m for m in plan.mappings if m.target_field not in decisions.reject and m.source_column not in decisions.reject], plan.name)
    run = run_plan(df, kept)
    out = run.table.drop("flagged")
    audit = [{"action": "rejected", "column": c} for c in decisions.reject]
    for c, value in decisions.set_all.items():
        out, n = set_all(out, c, value)
        audit.append({"action": "set all", "column": c, "value": value, "changed": n})
    for c, merges in decisions.merges.items():
        out = reduce(lambda d, g, c=c: merge_spellings(d, c, g["members"], g["into"]), merges, out)
        audit += [{"action": "merged", "column": c, "into": g["into"], "members": g["members"]} for g in merges]
    if decisions.remove_duplicates:
        before = out.count()
        out = D.dedupe(out, order=decisions.order)
        audit.append({"action": "removed duplicates", "rows": before - out.count()})
    return out, audit


@dataclass
class Decision:
    kind: str
    column: str
    detail: str
    status: str = "proposed"  # proposed, safe, accepted, rejected


class Ledger:
    """Decisions about a data set in order; safe ones need no approval."""

    def __init__(self):
        self.entries: list[Decision] = []

    def propose(self, kind: str, column: str, detail: str = "") -> Decision:
        self.entries.append(Decision(kind, column, detail))
        return self.entries[-1]

    def note_safe(self, kind: str, column: str, detail: str = "") -> Decision:
        self.entries.append(Decision(kind, column, detail, "safe"))
        return self.entries[-1]

    def accept(self, decision: Decision) -> None:
        decision.status = "accepted"

    def reject(self, decision: Decision) -> None:
        decision.status = "rejected"

    def pending(self) -> list[Decision]:
        return [d for d in self.entries if d.status == "proposed"]

    def summary(self) -> dict:
        kinds: dict[str, int] = {}
        for d in self.entries:
            kinds[d.kind] = kinds.get(d.kind, 0) + 1
        by = lambda s: sum(d.status == s for d in self.entries)
        return {"total": len(self.entries), "needs_approval": by("proposed"), "safe": by("safe"), "accepted": by("accepted"), "rejected": by("rejected"), "by_kind": kinds}

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(d.kind, d.column, d.detail, d.status) for d in self.entries], "kind string, column string, detail string, status string")
