"""Content digests, fingerprints and the verdict on a copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.canon import NULL_MARK, normalize
from tabloom.functions.text import quoted, text_of
from tabloom.model import Canon, Sort
from tabloom.plans.types import canon_of


def hash60(text: Column) -> Column:
    """Sixty bits of MD5, which other engines can compute as well.

    Never NULL, so a sum needs to look at it only once.
    """
    digits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10)
    return F.coalesce(digits.cast("bigint"), F.lit(0)).cast("decimal(28,0)")


def _hash(text: Column, portable: bool) -> Column:
    return hash60(text) if portable else F.xxhash64(text).cast("decimal(28,0)")


def digest_columns(df: DataFrame, canons: Mapping[str, Canon] | None = None, portable: bool = True,
                   row_hash: bool = False) -> dict[str, Column]:
    """The aggregates of a digest by name: ``rows`` and a sum per column.

    Hashes are ``decimal(28,0)``, so that their sum is ``decimal(38,0)``: 2^64
    times 10^18 rows fit.
    """
    canons = canons or {f.name: canon_of(f) for f in df.schema.fields}
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = {n: F.coalesce(normalize(quoted(n), types[n], k), F.lit(NULL_MARK)) for n, k in canons.items()}
    out = {"rows": F.count(F.lit(1))}
    for name, text in texts.items():
        out[name] = F.coalesce(F.sum(_hash(text, portable)), F.lit(0)).cast("decimal(38,0)")
    if row_hash:
        # Ties the columns of a row together: swapped values show up.
        out["row"] = F.coalesce(F.sum(_hash(F.concat_ws("\x1f", *texts.values()), portable)), F.lit(0)).cast("decimal(38,0)")
    return out


def digest(df: DataFrame, canons: Mapping[str, Canon] | None = None, portable: bool = True,
           row_hash: bool = False) -> DataFrame:
    """One row: the row count and, per column, the sum of a hash of its
    canonical values.  Independent of order and partitioning."""
    aggs = digest_columns(df, canons, portable, row_hash)
    return df.agg(*[c.alias("rows" if n == "rows" else f"sum_{n}") for n, c in aggs.items()])


def row_digest(df: DataFrame) -> Column:
    """A hash of all cells of a row, NULL told apart from empty text."""
    cells = [F.coalesce(F.concat(F.lit("\x01"), text_of(quoted(f.name), f.dataType)), F.lit("\x00"))
             for f in df.schema.fields]
    return F.concat_ws("\x1f", *cells)


def fingerprint(df: DataFrame, order: Sequence[Sort] | None = None) -> DataFrame:
    """SHA-256 of a result: its column names, its rows and its order.

    Rows are combined by sums, so no row has to wait for another.  The sequence
    that is meant sorts by ``order`` and, among rows with equal keys, by all
    cells; that makes it a function of the rows, which is why ``order`` enters
    as the sort itself.  Rows with equal sort keys have no order of their own
    in a DataFrame, so none is told apart.
    """
    names = "".join(n + "\x1f" for n in df.columns) + "\x1e"
    spec = ",".join(f"{s.column} {'desc' if s.desc else 'asc'}" for s in order or ())
    half = lambda at: F.coalesce(F.conv(F.substring("d", at, 15), 16, 10).cast("bigint"), F.lit(0)).cast("decimal(28,0)")
    one = df.select(F.md5(row_digest(df)).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(half(1)), F.lit(0)).alias("a"),
        F.coalesce(F.sum(half(17)), F.lit(0)).alias("b"))
    parts = [F.lit(names), F.lit(spec), F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")]
    return one.select(F.col("n").alias("rows"), F.sha2(F.concat_ws("\x1e", *parts), 256).alias("hash"))


def verify(source: DataFrame, target: DataFrame, canons: Mapping[str, Canon] | None = None, mode: str = "contents",
           appended: bool = False, row_hash: bool = False) -> DataFrame:
    """One verdict row: are the counts and the contents of both sides equal?

    ``mode`` is ``contents`` or ``counts``.  Contents are compared only when
    the counts match, and never for rows added to an existing table.
    """
    canons = canons or {f.name: canon_of(f) for f in source.schema.fields if f.name in target.columns}
    if mode != "contents":
        left = source.agg(F.count(F.lit(1)).alias("rows"))
        right = target.agg(F.count(F.lit(1)).alias("rows"))
        names: list[str] = []
    else:
        left, right = (digest(side, canons, portable=False, row_hash=row_hash) for side in (source, target))
        names = list(canons) + (["row"] if row_hash else [])
    pair = left.select(F.struct(*left.columns).alias("s")).withColumn(
        "t", right.select(F.struct(*right.columns)).scalar())
    same = F.col("s.rows") == F.col("t.rows")
    differing = F.filter(F.array(*[F.when(F.col("s")[f"sum_{n}"] != F.col("t")[f"sum_{n}"], n) for n in names])
                         if names else F.array().cast("array<string>"), lambda x: x.isNotNull())
    compared = F.lit(mode == "contents" and not appended) & same
    note = "appended to rows that were there before: contents left unread" if appended else ""
    return pair.select(
        F.col("s.rows").alias("source_rows"), F.col("t.rows").alias("target_rows"),
        F.when(F.lit(appended), "").when(same, "match").otherwise("differ").alias("counts"),
        F.when(~compared, "skipped").when(F.size(differing) == 0, "match").otherwise("differ").alias("contents"),
        F.when(compared, differing).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.when(F.lit(bool(note)), note).when(~same & F.lit(mode == "contents"),
                                             "unequal counts: contents left unread")
        .otherwise("").alias("note"))
