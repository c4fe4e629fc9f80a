"""Schema on read: documents, search hits, items and key-value records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.text import let, quoted
from tabloom.model import OVERFLOW

FIELD_MAP = "map<string,variant>"

# The type names of shapes inside documents.
GEO_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")

# Extended-JSON wrappers and the types they stand for.
WRAPPED_TYPES = {"$oid": "objectId", "$date": "date", "$numberDecimal": "decimal", "$numberLong": "long",
                 "$numberInt": "int", "$numberDouble": "double", "$binary": "binData", "$timestamp": "timestamp"}

# Item attribute tags.
ITEM_TAGS = ("S", "N", "BOOL", "B", "M", "L", "SS", "NS", "BS", "NULL")

# The elements each key-value type has.
KV_COLUMNS = {
    "string": ("value",), "hash": ("field", "value"), "list": ("index", "value"), "set": ("member",),
    "zset": ("member", "score"), "stream": ("id", "fields"), "json": ("value",),
}


def type_name_of(value: Column, shape: Column | None = None) -> Column:
    """The document type of a VARIANT value, whose schema text may be given."""
    def of_object(shape: Column) -> Column:
        kind = F.try_variant_get(value, "$.type", "string")
        geo = kind.isin(*GEO_TYPES) & (shape.contains("coordinates: ") | shape.contains("geometries: "))
        name = F.when(F.coalesce(geo, F.lit(False)), "geojson")
        for key, wrapped in WRAPPED_TYPES.items():
            name = name.when(shape.startswith(f"OBJECT<{key}: ") | shape.startswith(f"OBJECT<`{key}`: "), wrapped)
        return name.otherwise("object")

    def of_shape(shape: Column) -> Column:
        whole = F.try_variant_get(value, "$", "bigint")
        return (
            F.when(shape == "STRING", "string")
            .when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
                  F.when(whole.between(-2147483648, 2147483647), "int").otherwise("long"))
            .when(shape == "BOOLEAN", "bool")
            .when(value.isNull() | (shape == "VOID"), "null")
            .when(shape.startswith("D") & ~shape.startswith("DATE") | (shape == "FLOAT"), "double")
            .when(shape.startswith("ARRAY"), "array")
            .when(shape.startswith("OBJECT"), of_object(shape))
            .when(shape.startswith("TIMESTAMP") | (shape == "DATE"), "date")
            .when(shape == "BINARY", "binData")
            .otherwise("mixed"))

    return of_shape(shape) if shape is not None else let(F.schema_of_variant(value), of_shape)


def _fields(df: DataFrame, doc: str, order: Column | None) -> DataFrame:
    """One row per top-level field: where it stood, its name and its type.

    A document is parsed once; a name that it repeats counts once.
    """
    parsed = df.select(
        (order if order is not None else F.monotonically_increasing_id()).alias("__doc"),
        F.from_json(quoted(doc), FIELD_MAP).alias("__map"))
    keys, entries = F.map_keys("__map"), F.map_entries("__map")
    once = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(
        F.filter(entries, lambda e, i: F.array_position(F.map_keys("__map"), e["key"]) == i + 1))
    values = parsed.select("__doc", F.posexplode(once).alias("pos", "__entry")).select(
        "__doc", "pos", F.col("__entry.key").alias("field"), F.col("__entry.value").alias("__value"))
    # The schema text is its own step, as the type looks at it many times.
    shaped = values.withColumn("__shape", F.schema_of_variant("__value"))
    return shaped.select("__doc", "pos", "field", type_name_of(F.col("__value"), F.col("__shape")).alias("type"))


def infer_fields(df: DataFrame, doc: str, sample: int | None = None, order: Column | None = None) -> DataFrame:
    """The top-level fields of JSON documents.

    Columns: position, field, type, nullable, seen, total, percent.  ``type``
    is the only non-null type seen or ``mixed(a,b)``; fields stand in the
    order they were first seen, ``_id`` first.  All documents are read unless
    ``sample`` asks for fewer.
    """
    docs = df.select(quoted(doc).alias(doc), *([order.alias("__order")] if order is not None else []))
    if sample:
        docs = docs.limit(sample)
    order_col = F.col("__order") if order is not None else None
    found = _fields(docs, doc, order_col)
    # Document and place in one number where that can be, for a hash aggregate.
    place = F.struct("__doc", "pos")
    if isinstance(found.schema["__doc"].dataType, T.IntegralType):
        place = F.col("__doc").cast("decimal(28,0)") * 100_000 + F.col("pos")
    by_type = found.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    # At most one row per type name and field from here on.
    stats = by_type.groupBy("field").agg(
        F.sum("n").alias("seen"), F.min("first").alias("first"),
        F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type")))).alias("types"),
        F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"))
    total = docs.agg(F.count(F.lit(1)).alias("total")).scalar()
    shown = stats.withColumn("total", total).select(
        "field",
        F.when(F.size("types") == 0, "null").when(F.size("types") == 1, F.col("types")[0]).otherwise(
            F.concat(F.lit("mixed("), F.array_join("types", ","), F.lit(")"))).alias("type"),
        ((F.col("field") != "_id") & ((F.col("seen") < F.col("total")) | (F.col("nulls") > 0))).alias("nullable"),
        "seen", "total", F.floor(F.col("seen") * 100 / F.col("total")).cast("int").alias("percent"),
        (F.col("field") != "_id").alias("__other"), "first")
    return shown.orderBy("__other", "first").drop("__other", "first")


# The Spark type of a column of documents.
_COLUMN_TYPES = {"string": "string", "int": "bigint", "long": "bigint", "double": "double", "bool": "boolean"}


def _field_path(name: str) -> str | None:
    """The path of a top-level field; none when its name holds both quotes."""
    quote = next((q for q in "'\"" if q not in name), None)
    return f"$[{quote}{name}{quote}]" if quote and "\\" not in name else None


def _typed_field(name: str, type_name: str) -> Column:
    """A field of the document in ``__doc``, looked up by its name's place in the document's dictionary."""
    path, target = _field_path(name), _COLUMN_TYPES.get(type_name)
    if path is None:
        value = F.try_element_at(F.try_variant_get("__doc", "$", FIELD_MAP), F.lit(name))
        path = "$"
    else:
        value = F.col("__doc")
    if target:
        return F.try_variant_get(value, path, target).alias(name)
    # Anything else keeps its JSON text.
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), F.to_json(found)).alias(name)


def docs_to_rows(df: DataFrame, doc: str, columns: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Documents as rows over typed columns.

    ``columns`` maps field names to document types; without it they are
    inferred from all documents.  The other fields of a document go into one
    JSON object in the ``…`` column, NULL when there are none.  Text that is
    no JSON object stands there whole, as ``{"$unreadable": …}``.
    """
    if columns is None:
        # Field names are a schema: one row for each column of the result.
        columns = {r.field: r.type for r in infer_fields(df, doc).select("field", "type").collect()}
    names = list(columns)
    parsed = df.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keep)], quoted(doc).alias("__text"),
                       F.try_parse_json(quoted(doc)).alias("__doc"))
    whole = F.try_variant_get("__doc", "$", FIELD_MAP)
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*names)) if names else whole
    unread = F.col("__text").isNotNull() & whole.isNull()
    return parsed.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], *[_typed_field(n, t) for n, t in columns.items()],
        F.when(F.size(rest) > 0, F.to_json(rest)).when(
            unread, F.to_json(F.struct(F.col("__text").alias("$unreadable")))).alias(OVERFLOW))


def hits_to_rows(df: DataFrame, source: str, hit_id: str, fixed: Mapping[str, str] | None = None,
                 order: Column | None = None) -> DataFrame:
    """Search hits as rows: ``_id``, then every field.

    Fields stand in the order of the hit that first had them, by name within
    one hit; hits without a field have NULL there.
    """
    columns = dict(fixed or {})
    if fixed is None:
        ranked = _fields(df, source, order).groupBy("field", "type").agg(F.min("__doc").alias("first")).groupBy("field").agg(
            F.min("first").alias("first"),
            F.collect_set(F.when(F.col("type") != "null", F.col("type"))).alias("types"))
        for r in ranked.orderBy("first", "field").collect():
            columns[r.field] = r.types[0] if len(r.types) == 1 else "mixed"
    parsed = df.select(quoted(hit_id).alias("__hit"), F.try_parse_json(quoted(source)).alias("__doc"))
    return parsed.select(F.col("__hit").cast("string").alias("_id"),
                         *[_typed_field(n, t) for n, t in columns.items() if n != "_id"])


def item_columns(df: DataFrame, item: str, keys: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """Attribute names and types of items: keys first, the rest by name.

    The type is the one all values have, ``mixed`` when they differ; NULL
    values never decide.
    """
    tagged = df.select(F.explode(F.from_json(quoted(item), "map<string,map<string,variant>>")).alias("field", "cell")).select(
        "field", F.map_keys("cell")[0].alias("tag"))
    stats = tagged.groupBy("field").agg(
        F.array_sort(F.collect_set(F.when(F.col("tag").isin(*ITEM_TAGS), F.col("tag")).otherwise("?"))).alias("tags"))
    real = F.array_remove("tags", "NULL")
    out = stats.select("field", F.when(F.size(real) == 0, "NULL").when(F.size(real) == 1, real[0]).otherwise(
        "mixed").alias("type"))
    wanted = list(named) or list(keys)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("field")), F.lit(0)) if wanted else F.lit(0)
    ranked = out.withColumn("position", F.when(rank > 0, rank).otherwise(1 << 30))
    if named:
        ranked = ranked.where(F.col("field").isin(*named))
    return ranked.orderBy("position", "field").select("field", "type")


def items_to_rows(df: DataFrame, item: str, keys: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """Typed-attribute items as rows, laid out by ``item_columns``.

    Text, numbers (as exact text) and booleans are plain cells, sets arrays
    of text, everything else JSON.
    """
    layout = item_columns(df, item, keys, named).collect()
    parsed = df.select(F.from_json(quoted(item), "map<string,map<string,variant>>").alias("__item"))

    def cell(name: str, tag: str) -> Column:
        value = F.try_element_at("__item", F.lit(name))
        inner = F.try_element_at(value, F.lit(tag))
        if tag in ("S", "N", "B"):
            return F.try_variant_get(inner, "$", "string").alias(name)
        if tag == "BOOL":
            return F.try_variant_get(inner, "$", "boolean").alias(name)
        if tag in ("SS", "NS", "BS"):
            return F.try_variant_get(inner, "$", "array<string>").alias(name)
        if tag in ("M", "L"):
            return F.to_json(inner).alias(name)
        first = F.map_values(value)[0]
        shown = F.coalesce(F.try_variant_get(first, "$", "string"), F.to_json(first))
        return F.when(F.map_keys(value)[0] != "NULL", shown).alias(name)

    return parsed.select(*[cell(r.field, r.type) for r in layout])


def explode_kv(df: DataFrame, kv_type: str, key: str = "key", type_column: str = "type", payload: str = "payload") -> DataFrame:
    """The elements of all records of one key-value type.

    The payload is JSON text: an object for hashes (field to value) and
    sorted sets (member to score), an array for lists and sets, an array of
    ``{"id", "fields"}`` for streams.
    """
    if kv_type not in KV_COLUMNS:
        raise ValueError(f"unknown key type {kv_type!r}")
    rows = df.where(quoted(type_column) == kv_type) if type_column in df.columns else df
    k, p = quoted(key), quoted(payload)
    if kv_type in ("string", "json"):
        return rows.select(k, p.alias("value"))
    if kv_type == "hash":
        return rows.select(k, F.explode(F.map_entries(F.from_json(p, "map<string,string>"))).alias("e")).select(
            quoted(key), F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    if kv_type == "zset":
        return rows.select(k, F.explode(F.map_entries(F.from_json(p, "map<string,double>"))).alias("e")).select(
            quoted(key), F.col("e.key").alias("member"), F.col("e.value").alias("score"))
    if kv_type == "list":
        return rows.select(k, F.posexplode(F.from_json(p, "array<string>")).alias("index", "value")).withColumn(
            "index", F.col("index").cast("bigint"))
    if kv_type == "set":
        return rows.select(k, F.explode(F.from_json(p, "array<string>")).alias("member"))
    entry = "array<struct<id:string,fields:map<string,string>>>"
    return rows.select(k, F.explode(F.from_json(p, entry)).alias("e")).select(
        quoted(key), F.col("e.id").alias("id"), F.col("e.fields").alias("fields"))


def glob_regex(glob: str) -> str:
    """A key pattern (``*``, ``?``, ``[abc]``, ``[^a]``, ``\\x``) as a regular expression."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 1)
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\")
            out.append("[" + body + "]")
            i = close
        else:
            if ch == "\\" and i + 1 < len(glob):
                i += 1
                ch = glob[i]
            out.append("\\" + ch if ch in "\\^$.|?*+()[]{}" else ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def match_keys(df: DataFrame, glob: str = "*", limit: int | None = None, key: str = "key", type_column: str = "type",
               payload: str = "payload") -> DataFrame:
    """Keys matching a pattern, with their type and number of elements, by name; all unless ``limit`` is given."""
    t, p = quoted(type_column), quoted(payload)
    size = (F.when(t.isin("hash", "zset"), F.size(F.json_object_keys(p)))
            .when(t.isin("list", "set", "stream"), F.json_array_length(p)))
    found = df.where(quoted(key).rlike(glob_regex(glob or "*"))).select(
        quoted(key).alias("name"), t.alias("kind"), size.cast("bigint").alias("rows")).orderBy("name")
    return found.limit(limit) if limit else found


def fields_set(fields: Column, changes: Mapping[str, Column], unset: Sequence[str] = ()) -> Column:
    """Document update: given fields set, named fields removed; others stay."""
    touched = [*changes, *unset]
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*touched)) if touched else fields
    if not changes:
        return kept
    parts = []
    for name, value in changes.items():
        parts += [F.lit(name), value]
    return F.map_concat(kept, F.create_map(*parts))
