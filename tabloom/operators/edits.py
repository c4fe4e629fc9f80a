"""A batch of inserts, updates and deletes in which every change hits one row.

A change frame has the columns ``change_id``, ``op`` (insert, update or
delete), ``key_<column>`` for each key column, and ``set_<column>`` with a
flag ``has_<column>`` for each value column that some change sets.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.text import quoted
from tabloom.operators.browse import field_of
from tabloom.session import materialize, work_path


class EditError(ValueError):
    """A change that cannot be applied; nothing was saved."""


@dataclass(frozen=True)
class EditResult:
    table: DataFrame
    applied: int
    path: str | None = None


def input_value(value: Any, dtype: T.DataType, default: str | None = None) -> Column:
    """A cell from the editor: markers, base64 binary, JSON text or a plain value."""
    if isinstance(value, dict):
        if value.get("$null"):
            return F.lit(None).cast(dtype)
        if value.get("$default"):
            return (F.expr(default) if default else F.lit(None)).cast(dtype)
        if str(value.get("$expr", "")).strip():
            return F.expr(value["$expr"]).cast(dtype)
        if "$bin" in value:
            return F.unbase64(F.lit(value["$bin"]))
        if "$text" in value:
            return F.lit(value["$text"]).cast(dtype)
        raise ValueError("unsupported value")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) and isinstance(value, str):
        return F.from_json(F.lit(value), dtype.simpleString())
    if isinstance(dtype, T.VariantType) and isinstance(value, str):
        return F.parse_json(F.lit(value))
    return F.lit(value).cast(dtype)


def cast_inputs(df: DataFrame, changes: Sequence[Mapping[str, Any]], key: Sequence[str],
                defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Changes written by a person as a change frame for ``df``."""
    spark = df.sparkSession
    defaults = defaults or {}
    touched = [f for f in df.schema.fields if any(f.name in c.get("values", {}) for c in changes)]
    one = spark.range(1)
    frames = []
    for i, change in enumerate(changes):
        cols = [F.lit(i + 1).cast("bigint").alias("change_id"), F.lit(change["op"]).alias("op")]
        for k in key:
            given = change.get("key", change.get("values", {}) if change["op"] == "insert" else {})
            if k not in given and change["op"] != "insert":
                raise EditError(f"change {i + 1} has no value for key {k!r}")
            cols.append(input_value(given.get(k), field_of(df, k).dataType).alias(f"key_{k}"))
        for f in touched:
            given = change.get("values", {})
            value = input_value(given[f.name], f.dataType, defaults.get(f.name)) if f.name in given \
                else F.lit(None).cast(f.dataType)
            cols += [value.alias(f"set_{f.name}"), F.lit(f.name in given).alias(f"has_{f.name}")]
        frames.append(one.select(*cols))
    return reduce(DataFrame.unionByName, frames)


def effective(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Without the updates that set nothing, which are passed over."""
    flags = [quoted(f"has_{f.name}") for f in df.schema.fields if f"has_{f.name}" in changes.columns]
    sets = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), flags, F.lit(False))
    return changes.where((F.col("op") != "update") | sets)


def match_counts(df: DataFrame, changes: DataFrame, key: Sequence[str], small: bool | None = None) -> DataFrame:
    """How many rows each update and delete would hit; NULL keys match NULL.

    Spark broadcasts the changes when their bytes are few, and the table is not
    shuffled then.  With ``small=False`` the table's keys are counted before
    the join, so a repeated key is one row.
    """
    wanted = changes.where(F.col("op") != "insert").select("change_id", *[quoted(f"key_{k}") for k in key])
    on = lambda left: [left[f"t{i}"].eqNullSafe(quoted(f"key_{k}")) for i, k in enumerate(key)]
    keys = df.select(*[quoted(k).alias(f"t{i}") for i, k in enumerate(key)])
    if small is not False:
        hits = keys.join(wanted, on(keys)).groupBy("change_id").agg(F.count(F.lit(1)).alias("rows"))
    else:
        counted = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("__rows"))
        hits = counted.join(wanted, on(counted)).groupBy("change_id").agg(F.sum("__rows").alias("rows"))
    return wanted.select("change_id").join(hits, "change_id", "left").select(
        "change_id", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def insert_conflicts(df: DataFrame, changes: DataFrame, key: Sequence[str], small: bool | None = None) -> DataFrame:
    """Inserts whose key exists already, in the table or in the batch itself.

    Inserts of few bytes are broadcast by Spark, and the table is not shuffled then.
    """
    rows = changes.where(F.col("op") == "insert").select("change_id", *[quoted(f"key_{k}") for k in key])
    rows = rows.where(reduce(and_, [quoted(f"key_{k}").isNotNull() for k in key]))
    keys = df.select(*[quoted(k).alias(f"t{i}") for i, k in enumerate(key)])
    on = [quoted(f"key_{k}") == F.col(f"t{i}") for i, k in enumerate(key)]
    if small is not False:
        taken = keys.join(rows, on).select(*rows.columns).distinct()
    else:
        taken = rows.join(keys, on, "left_semi")
    # A row deleted earlier in the batch has freed its key.
    freed = changes.where(F.col("op") == "delete").groupBy(*[quoted(f"key_{k}").alias(f"d{i}") for i, k in enumerate(key)]).agg(
        F.min("change_id").alias("__deleted"))
    taken = taken.join(freed, [quoted(f"key_{k}") == F.col(f"d{i}") for i, k in enumerate(key)]
                       + [F.col("__deleted") < F.col("change_id")], "left_anti")
    repeated = rows.groupBy(*[quoted(f"key_{k}") for k in key]).agg(
        F.max("change_id").alias("change_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return taken.select("change_id").union(repeated.select("change_id")).distinct()


def stale_changes(df: DataFrame, changes: DataFrame, key: Sequence[str], version: str, seen: str = "seen_version",
                  small: bool | None = None) -> DataFrame:
    """Updates and deletes that were checked against another version of their row."""
    wanted = changes.where(F.col("op") != "insert").select("change_id", quoted(seen), *[quoted(f"key_{k}") for k in key])
    keys = df.select(*[quoted(k).alias(f"t{i}") for i, k in enumerate(key)], quoted(version).alias("__version"))
    on = [quoted(f"key_{k}").eqNullSafe(F.col(f"t{i}")) for i, k in enumerate(key)]
    on.append(quoted(seen).eqNullSafe(F.col("__version")))
    if small is not False:
        current = keys.join(wanted, on).select("change_id").distinct()
        return wanted.select("change_id").join(current, "change_id", "left_anti")
    return wanted.join(keys, on, "left_anti").select("change_id")


def validate(df: DataFrame, changes: DataFrame, key: Sequence[str], version: str | None = None,
             small: bool | None = None) -> None:
    """Raise for the first change that cannot be applied."""
    unknown = changes.where(~F.col("op").isin("insert", "update", "delete")).limit(1).collect()
    if unknown:
        raise EditError(f"{unknown[0].op!r} is no change")
    wrong = match_counts(df, changes, key, small).where("rows <> 1").orderBy("change_id").limit(1).collect()
    if wrong:
        r = wrong[0]
        if r.rows == 0:
            raise EditError(f"change {r.change_id}: no row has this key any more")
        raise EditError(f"change {r.change_id} hits {r.rows} rows instead of one, so the batch was refused")
    gone = changes.where(F.col("op") != "insert").groupBy(*[quoted(f"key_{k}") for k in key]).agg(
        F.min(F.when(F.col("op") == "delete", F.col("change_id"))).alias("deleted"),
        F.max("change_id").alias("change_id")).where("change_id > deleted").orderBy("change_id").limit(1).collect()
    if gone:
        raise EditError(f"change {gone[0].change_id}: no row has this key any more")
    taken = insert_conflicts(df, changes, key, small).orderBy("change_id").limit(1).collect()
    if taken:
        raise EditError(f"change {taken[0].change_id}: its key is taken")
    if version is not None:
        stale = stale_changes(df, changes, key, version, small=small).orderBy("change_id").limit(1).collect()
        if stale:
            raise EditError(f"change {stale[0].change_id}: the row has a newer version than the one that was edited")


def edited(df: DataFrame, changes: DataFrame, key: Sequence[str], small: bool | None = None) -> DataFrame:
    """The table with valid changes applied, as a plan."""
    set_names = [f.name for f in df.schema.fields if f"set_{f.name}" in changes.columns]
    # Several changes of one row become one: the last value set wins.
    wanted = changes.where(F.col("op") != "insert").groupBy(*[quoted(f"key_{k}") for k in key]).agg(
        F.max_by("op", "change_id").alias("__op"),
        *[F.max_by(F.struct(quoted(f"set_{n}").alias("v")), F.when(quoted(f"has_{n}"), F.col("change_id"))).alias(f"set_{n}")
          for n in set_names],
        *[F.coalesce(F.bool_or(quoted(f"has_{n}")), F.lit(False)).alias(f"has_{n}") for n in set_names])
    on = [quoted(k).eqNullSafe(quoted(f"key_{k}")) for k in key]
    joined = df.join(wanted, on, "left").where(~F.col("__op").eqNullSafe(F.lit("delete")))
    kept = joined.select(*[
        F.when(F.coalesce(quoted(f"has_{f.name}"), F.lit(False)), quoted(f"set_{f.name}")["v"].cast(f.dataType))
        .otherwise(quoted(f.name)).alias(f.name) if f.name in set_names else quoted(f.name)
        for f in df.schema.fields])
    added = changes.where(F.col("op") == "insert").select(*[
        (quoted(f"key_{f.name}") if f.name in key else quoted(f"set_{f.name}") if f.name in set_names else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return kept.unionByName(added)


def apply_edits(df: DataFrame, changes: DataFrame, key: Sequence[str], target: str | None = None,
                version: str | None = None) -> EditResult:
    """Check every change, then write the table's next version.

    The batch is stored first, so that checking and applying see the same
    changes.  Nothing is written when any change fails.
    """
    batch = materialize(effective(df, changes), "changes")
    validate(df, batch, key, version)
    applied = batch.count()
    path = target or work_path(df.sparkSession, "edited")
    edited(df, batch, key).write.mode("errorifexists").parquet(path)
    return EditResult(df.sparkSession.read.schema(df.schema).parquet(path), applied, path)


@dataclass(frozen=True)
class ColumnDef:
    """A desired column, linked to an existing one by its original name."""

    name: str
    original: str | None = None
    type: str | None = None
    default: str | None = None
    generated: str | None = None


# What other engines call the moment, the day and a new identifier, and their words for yes and no.
_NOW = ("now getdate sysdate systimestamp sysdatetime localtimestamp current_timestamp sysdatetimeoffset sysutcdatetime "
        "getutcdate").split()
_TODAY = "current_date curdate today".split()
_UUID = "uuid gen_random_uuid newid uuid_generate_v sys_guid generateuuidv uuid_string".split()
_YES, _NO = ("true", "1", "t", "y"), ("false", "0", "f", "n")

# Names of calls without their brackets and digits, the Spark call, and the kinds that take it (none: all).
_CALLS = [(_NOW, "current_timestamp()", ("datetime", "timestamptz")), (_TODAY, "current_date()", ()), (_UUID, "uuid()", ())]
_CONSTANT = re.compile(r"""(?ix) ^ [(\s]* (?P<prefix> [nb](?=') )? (?P<value> '(?:[^']|'')*' | [-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)? | true | false | null )
                           [)\s]* (?: ::[\w\s"]+ (?:\(\d+\))? )? [)\s]* $""")
_CALL = re.compile(r"^[(\s]*([a-z_]+)\d*\s*(?:\(\d*\))?[)\s]*$", re.I)


def translate_default(default: str | None, canon_t: str) -> tuple[str | None, str]:
    """A column default as a Spark expression, or None with a note.

    Constants are kept; calls go by a table of names; all else is left out.
    """
    text = (default or "").strip()
    constant, call = _CONSTANT.match(text), _CALL.match(text)
    if not text or (constant and constant["value"].lower() == "null"):
        return None, ""
    if canon_t == "bool":
        word = constant["value"].strip("'").lower() if constant else ""
        found = "true" if word in _YES else "false" if word in _NO else None
    elif constant and constant["value"].lower() not in ("true", "false") and (constant["prefix"] or "").lower() != "b":
        found = constant["value"]
    else:
        name = call[1].lower() if call else ""
        found = next((spark for names, spark, kinds in _CALLS if name in names and (not kinds or canon_t in kinds)), None)
    return found, "" if found else f"left without its default {default}, which has no counterpart here"


def restructure(df: DataFrame, columns: Sequence[ColumnDef]) -> DataFrame:
    """Rename, retype, add, drop, reorder and compute columns in one select.

    Columns not listed are dropped; computed columns see the new ones.
    """
    stored, computed = [], []
    for c in columns:
        if c.generated:
            computed.append(c)
            continue
        if c.original:
            field = field_of(df, c.original)
            col = quoted(c.original)
            stored.append((col.cast(c.type) if c.type and c.type != field.dataType.simpleString() else col).alias(c.name))
        else:
            expr, _ = translate_default(c.default, "other")
            default = F.expr(c.default) if c.default and expr is None else F.expr(expr) if expr else F.lit(None)
            stored.append(default.cast(c.type or "string").alias(c.name))
    out = df.select(*stored)
    for c in computed:
        col = F.expr(c.generated)
        out = out.withColumn(c.name, col.cast(c.type) if c.type else col)
    return out.select(*[quoted(c.name) for c in columns])
