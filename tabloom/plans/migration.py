"""Copying tables between schemas: plan, convert, load, verify."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tabloom.functions.convert import convert, spark_type_of
from tabloom.functions.text import quoted
from tabloom.model import OVERFLOW, Canon, Report, TableMeta, apply_case, clip_ident, parents_first
from tabloom.operators.verify import digest, digest_columns, verify
from tabloom.plans.types import LakeType, canon_of, lake_type
from tabloom.sinks.load import load, path_exists, read_loaded



@dataclass(frozen=True)
class ColumnPlan:
    source: str
    target: str
    src: Canon
    dst: Canon
    lake: LakeType
    include: bool = True


@dataclass(frozen=True)
class TablePlan:
    meta: TableMeta
    target: str
    columns: tuple[ColumnPlan, ...]
    include: bool = True
    rows_mode: str = "append"  # append or replace
    existing: str = "fail"  # fail, replace or keep
    fold_rest: str | None = None
    notes: tuple[str, ...] = ()

    def included(self) -> list[ColumnPlan]:
        return [c for c in self.columns if c.include]


@dataclass(frozen=True)
class Options:
    case: str = "keep"
    engine: str = "lake"
    verify: str = "contents"  # contents or counts
    exclude: Sequence[str] = ()
    existing: str = "fail"


def plan_table(df: DataFrame, meta: TableMeta, options: Options = Options()) -> TablePlan:
    """A proposed target table: names, types and notes."""
    columns, notes = [], []
    for f in df.schema.fields:
        column = meta.column(f.name)
        src = canon_of(f)
        if column and column.kind in ("uuid", "enum", "geometry", "json", "interval", "time"):
            src = src.with_(t=column.kind, values=column.enum, srid=column.srid)
        lake = lake_type(src)
        # JSON and nested values are copied as JSON text.
        columns.append(ColumnPlan(f.name, clip_ident(options.engine, apply_case(f.name, options.case)), src,
                                  lake.canon, lake, include=not (column and column.generated)))
        notes += [f"{f.name}: {n}" for n in lake.notes]
        if column and column.generated:
            notes.append(f"{f.name}: computed from other columns, not copied")
    name = clip_ident(options.engine, apply_case(meta.name, options.case))
    return TablePlan(meta, name, tuple(columns), meta.name not in options.exclude, existing=options.existing, notes=tuple(notes))


def match_key_types(plans: Mapping[str, TablePlan]) -> dict[str, TablePlan]:
    """Foreign-key columns take the type of the column they refer to."""
    out = dict(plans)
    for p in parents_first([p.meta for p in plans.values()]):
        child = out[p.name]
        for fk in p.foreign_keys:
            parent = out.get(fk.parent)
            if parent is None:
                continue
            wanted = {c: next((x for x in parent.columns if x.source == pc), None)
                      for c, pc in zip(fk.columns, fk.parent_columns)}
            child = replace(child, columns=tuple(
                replace(c, dst=wanted[c.source].dst, lake=wanted[c.source].lake) if wanted.get(c.source) else c
                for c in child.columns))
        out[p.name] = child
    return out


def plan(tables: Mapping[str, tuple[DataFrame, TableMeta]], options: Options = Options()) -> list[TablePlan]:
    """Plans of all tables in load order, parents first."""
    plans = match_key_types({n: plan_table(df, meta, options) for n, (df, meta) in tables.items()})
    seen: dict[str, str] = {}
    for p in plans.values():
        if p.target.lower() in seen:
            raise ValueError(f"{p.meta.name} and {seen[p.target.lower()]} would have the same target name {p.target}")
        seen[p.target.lower()] = p.meta.name
    return [plans[m.name] for m in parents_first([p.meta for p in plans.values()])]


def existing_targets(spark: SparkSession, root: str, plans: Sequence[TablePlan]) -> set[str]:
    """Lower-cased names of the target tables that exist."""
    return {p.target.lower() for p in plans if path_exists(spark, f"{root.rstrip('/')}/{p.target}")}


def target_mode(existing: bool, policy: str, rows_mode: str) -> str:
    """What to do with a target: create, append, replace or skip."""
    if not existing:
        return "create"
    if policy == "fail":
        raise ValueError("the target table exists already")
    if policy == "replace":
        return "replace"
    if policy == "keep":
        if rows_mode not in ("append", "replace"):
            raise ValueError(f"unknown row mode {rows_mode!r}")
        return rows_mode
    raise ValueError(f"unknown policy {policy!r} for existing tables")


def converted(df: DataFrame, p: TablePlan) -> DataFrame:
    """The planned columns in their target types, as one projection."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [convert(quoted(c.source), types[c.source], c.src, c.dst).alias(c.target) for c in p.included()]
    if p.fold_rest:
        cols.append(fold_rest(df, [c.source for c in p.included()]).alias(p.fold_rest))
    return df.select(*cols)


def fold_rest(df: DataFrame, planned: Sequence[str]):
    """The unplanned columns of a row as one JSON object, NULL when all are NULL."""
    rest = [f for f in df.schema.fields if f.name not in planned and f.name != OVERFLOW]
    if not rest:
        return F.lit(None).cast("string")
    packed = F.to_json(F.struct(*[quoted(f.name) for f in rest]))
    return F.when(packed != "{}", packed)


def copy_table(df: DataFrame, p: TablePlan, root: str) -> tuple[DataFrame, dict]:
    """Convert and load one table; the digest of the source is taken in the same scan."""
    canons = {c.source: c.src for c in p.included()}
    aggs = digest_columns(df.select(*[quoted(n) for n in canons]), canons, portable=False)
    watch = Observation(f"copy-{uuid.uuid4().hex}")
    watched = df.observe(watch, *[c.alias("rows" if n == "rows" else f"sum_{n}") for n, c in aggs.items()])
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{p.target}"
    mode = target_mode(path_exists(spark, path), p.existing, p.rows_mode)
    target = load(converted(watched, p), path, "replace" if mode == "replace" else "append")
    return target, {"path": path, "mode": mode, **watch.get}


def verify_copy(source: DataFrame, target: DataFrame, p: TablePlan, mode: str = "contents", appended: bool = False) -> DataFrame:
    """Both sides normalized by the source's types, column by column."""
    back = target.select(*[quoted(c.target).alias(c.source) for c in p.included()])
    return verify(source, back, {c.source: c.src for c in p.included()}, mode, appended)


def verify_digest(spark: SparkSession, seen: Mapping, target: DataFrame, p: TablePlan) -> DataFrame:
    """A verdict from the digest taken while copying: only the target is read."""
    back = target.select(*[quoted(c.target).alias(c.source) for c in p.included()])
    got = digest(back, {c.source: c.src for c in p.included()}, portable=False)
    names = [c.source for c in p.included()]
    differing = F.filter(F.array(*[
        F.when(F.col(f"sum_{n}") != F.lit(str(seen[f"sum_{n}"])).cast("decimal(38,0)"), n) for n in names]),
        lambda x: x.isNotNull())
    same = F.col("rows") == F.lit(seen["rows"])
    return got.select(
        F.lit(p.meta.name).alias("table"), F.lit(seen["rows"]).cast("bigint").alias("source_rows"),
        F.col("rows").alias("target_rows"), F.when(same, "match").otherwise("differ").alias("counts"),
        F.when(~same, "skipped").when(F.size(differing) == 0, "match").otherwise("differ").alias("contents"),
        differing.alias("columns"))


@dataclass
class Migration:
    """A run over all planned tables, with one report per table."""

    tables: Mapping[str, tuple[DataFrame, TableMeta]]
    root: str
    options: Options = field(default_factory=Options)
    log: Callable[[str], None] = lambda _: None

    def run(self) -> DataFrame:
        spark = next(iter(self.tables.values()))[0].sparkSession
        reports = []
        for p in plan(self.tables, self.options):
            source = self.tables[p.meta.name][0]
            if not p.include:
                reports.append(Report(p.meta.name, "excluded"))
                continue
            try:
                target, seen = copy_table(source, p, self.root)
            except Exception as e:  # reported per table; the others go on
                reports.append(Report(p.meta.name, "failed", notes=[str(e).split("\n", 1)[0]]))
                continue
            verdict = verify_digest(spark, seen, target, p).first() if seen["mode"] != "append" else None
            words = "skipped" if verdict is None else (
                verdict.contents if verdict.counts == "match" and self.options.verify == "contents" else verdict.counts)
            reports.append(Report(p.meta.name, "done", seen["rows"], list(p.notes), words))
            self.log(f"{p.meta.name}: {seen['rows']} rows")
        rows = [(i + 1, r.table, r.status, r.rows, r.notes, r.verdict) for i, r in enumerate(reports)]
        return spark.createDataFrame(
            rows, "position int, table string, status string, rows bigint, notes array<string>, verdict string")


def target_schema(p: TablePlan) -> dict[str, str]:
    """Target column to the Spark type that will be stored."""
    return {c.target: spark_type_of(c.dst).simpleString() for c in p.included()}


def open_target(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_loaded(spark, f"{root.rstrip('/')}/{name}")
