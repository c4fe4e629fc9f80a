"""Edits of a loaded table that write only the files they touch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.text import quoted
from tabloom.operators.edits import EditResult, edited, effective, validate
from tabloom.session import materialize
from tabloom.sinks.load import LoadConflict, _fs, _publish, read_loaded, versions


def touched_files(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> list[str]:
    """The data files that hold a row which an update or delete means; keys and file names are all that is read."""
    wanted = changes.where(F.col("op") != "insert").select(*[quoted(f"key_{k}") for k in key]).distinct()
    rows = table.select(*[quoted(k).alias(f"t{i}") for i, k in enumerate(key)], F.col("_metadata.file_path").alias("file"))
    same = [F.col(f"t{i}").eqNullSafe(quoted(f"key_{k}")) for i, k in enumerate(key)]
    return [r.file for r in rows.join(wanted, same, "left_semi").select("file").distinct().toLocalIterator()]


def edit_loaded(spark: SparkSession, target: str, changes: DataFrame, key: Sequence[str], version: str | None = None) -> EditResult:
    """Check every change against the current version of ``target``, and publish the next one.

    Only files with a changed row are written again; the next version names
    all others as they are.  Nothing is visible when a change fails, and
    ``LoadConflict`` tells that another writer published meanwhile.
    """
    root, now = target.rstrip("/"), max(versions(spark, target), default=0)
    table = read_loaded(spark, root, version=now or None)
    batch = materialize(effective(table, changes), "changes")
    validate(table, batch, key, version)
    hit = touched_files(table, batch, key)
    named = lambda uri: "/".join(uri.rstrip("/").rsplit("/", 2)[1:])
    again = {named(f) for f in hit}
    kept = [n for n in map(named, table.inputFiles()) if n not in again]
    old = spark.read.schema(table.schema).parquet(*[f"{root}/{n}" for n in sorted(again)]) if again else spark.createDataFrame([], table.schema)
    folder = f"b={uuid.uuid4().hex[:16]}"
    try:
        edited(old, batch, key).coalesce(max(1, len(again))).write.parquet(f"{root}/{folder}")
        _publish(spark, root, now + 1, [*kept, folder])
    except BaseException as e:
        fs, p = _fs(spark, f"{root}/{folder}")
        fs.delete(p, True)
        if isinstance(e, FileExistsError):
            raise LoadConflict(f"{target} has a version {now + 1} already") from None
        raise
    return EditResult(read_loaded(spark, root, schema=table.schema), batch.count(), f"{root}/_versions/{now + 1}")
