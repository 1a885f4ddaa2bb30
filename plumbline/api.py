"""Whole workflows as functions: profile, clean with review, structure, decide, export."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import clusters, duplicates, headers, review
from plumbline.operators.distribution import distribution_profile
from plumbline.operators.domains import Domains
from plumbline.operators.profile import ColumnProfile, profile, profile_to_plan
from plumbline.plans.plan import Plan, Run, run_plan
from plumbline.sources.files import head
from plumbline.sources.router import read_any
from plumbline.sources.sniff import IngestReport

PREVIEW, SIMILAR_COLUMNS = 50, 12


@dataclass
class Region:
    """What differs between countries; an argument, not a global."""

    key: str
    name: str
    phone_region: str
    date_order: str
    currency: tuple[str, ...] = ()
    #: JSON files of the region's states ({"states": [...]}, {"canonical": [...]} or a plain list or object) and of its
    #: places ({"places": {place: state}} or a plain object).
    states_ref: str | None = None
    places_ref: str | None = None


# --- Fixed values: regions. ---
REGIONS = {"GENERIC": Region("GENERIC", "Generic", "US", "MDY"), "NG": Region("NG", "Nigeria", "NG", "DMY", ("₦", "NGN"))}
# --- End of fixed values. ---


def register_region(region: Region) -> None:
    REGIONS[region.key] = region


def get_region(key: str) -> Region:
    return REGIONS.get(key, REGIONS["GENERIC"])


def list_regions() -> list[str]:
    return sorted(REGIONS)


def load_reference(spark: SparkSession, region: Region) -> dict:
    """{"states": names, "places": {place: state}} of a region's files, for `profile`; {} for a region without any."""

    def content(path: str | None) -> dict | list | None:
        return json.loads(head(spark, path, 1 << 28)) if path else None

    states, places, out = content(region.states_ref), content(region.places_ref), {}
    if states is not None:
        listed = states.get("states") or states.get("canonical") or states if isinstance(states, dict) else states
        out["states"] = list(listed)
        out["places"] = dict((places or {}).get("places", places or {}))
    return out


def profile_file(spark: SparkSession, path: str) -> dict:
    """Ingest report, proposed headers, types and a preview of a file."""
    df, report = read_any(spark, path)
    found = profile(df)
    return {"ingest": asdict(report), "headers": headers.propose_headers(found), "types": [asdict(p) for p in found], "preview": [r.asDict() for r in df.limit(PREVIEW).collect()]}


@dataclass
class Session:
    """A cleaned file under review."""

    table: DataFrame
    ingest: IngestReport
    profiles: list[ColumnProfile]
    run: Run
    worklist: dict = field(default_factory=dict)

    def overview(self) -> DataFrame:
        return review.column_overview(self.run)

    def spotcheck(self, n: int = 20, seed: int = 1) -> DataFrame:
        return review.spotcheck(self.run, n, seed)

    def decide(self, decisions: review.Decisions) -> tuple[DataFrame, list[dict]]:
        return review.apply_decisions(self.table, self.run.plan, decisions)


def clean(spark: SparkSession, path: str, region: str = "GENERIC", rename: dict[str, str] | None = None, types: dict[str, str] | None = None, plan: Plan | dict | None = None, similar: bool = True, tell: Callable[[dict], None] = lambda _: None) -> Session:
    """Reads, profiles, plans and cleans a file, and lists what needs a decision. `tell` hears of each step."""
    df, report = read_any(spark, path)
    tell({"step": "read", "columns": len(df.columns)})
    if rename:
        df = df.withColumnsRenamed(rename)
    found = profile(df, **load_reference(spark, get_region(region)))
    for p in found:
        if types and p.column in types:
            p.semantic_type = types[p.column]
            p.transform = {"numeric": "numeric", "date": "date_iso", "datetime": "datetime_iso", "phone": "phone", "email": "email", "gender": "gender", "boolean": "boolean", "name": "name", "geo": "resolve", "categorical": "auto_categorical", "identifier": "fixed_id", "free_text": "text_normalise"}.get(types[p.column])
            p.params = {}
    tell({"step": "profiled"})
    where = get_region(region)
    plan = Plan.of(plan) if plan is not None else profile_to_plan(found)
    for m in plan.mappings:
        if m.transform == "phone":
            m.params.setdefault("region", where.phone_region)
        if m.transform in ("date_iso", "datetime_iso"):
            m.params.setdefault("date_order", where.date_order)
    run = run_plan(df, plan)
    session = Session(df, report, found, run)
    session.worklist = {"duplicate_columns": duplicates.duplicate_columns(df.columns), "flags": run.counts().where("flagged > 0")}
    if similar:
        texts = [p.column for p in found if p.semantic_type in ("categorical", "geo", "name", "free_text") and 2 <= p.evidence.get("distinct", 0) <= clusters.ALL_PAIRS][:SIMILAR_COLUMNS]
        session.worklist["similar"] = {c: clusters.cluster_similar(df, c) for c in texts}
    tell({"step": "done"})
    return session


def structure(df: DataFrame) -> dict:
    """Rows, columns and, for each, its type, predicted field and domain."""
    found = profile(df)
    domains = Domains(spark=df.sparkSession)
    fields = {f["column"]: f for f in headers.predict_fields(found)}
    columns = [{**fields[p.column], "semantic_type": p.semantic_type, "domain": domains.detect_column(df, p.column) if p.semantic_type in ("geo", "categorical", "gender") else None} for p in found]
    return {"rows": df.count(), "columns": columns}


def distribution(df: DataFrame, after: DataFrame | None = None) -> list[dict]:
    from plumbline.operators.distribution import before_after

    return distribution_profile(df) if after is None else before_after(df, after)


def status() -> dict:
    """What is at hand: tools, transforms, regions, and readers that plug-ins added."""
    from plumbline.operators.toolkit import TOOLS
    from plumbline.operators.transforms import list_transforms
    from plumbline.sources.router import PLUGINS

    return {"tools": sorted(TOOLS), "transforms": list_transforms(), "regions": list_regions(), "plugins": sorted(PLUGINS)}


def cancel(spark: SparkSession, group: str) -> None:
    """Stops the jobs of a group set by sparkContext.setJobGroup."""
    spark.sparkContext.cancelJobGroup(group)
