"""Filters of document, search-index, item, wide-column and key-value stores."""


from pyspark.sql import functions as F

from tabloom.model import Filter
from tabloom.operators import browse as b, flavours as v
from tabloom.workloads.registry import query


def _counts(df, compile_filter, filters):
    return df.agg(*[F.count_if(compile_filter(df, f)).alias(n) for n, f in filters.items()])


def _labelled(t):
    """Documents with their labels; unlabelled ones lack the fields."""
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


_LABELLED = "(SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query("document_filters", f"""SELECT count(*) FILTER (WHERE quality = 1) AS eq, count(*) FILTER (WHERE quality IS NULL OR quality <> 1) AS ne,
  count(*) FILTER (WHERE quality > 0) AS gt, count(*) FILTER (WHERE quality IN (1)) AS ins, count(*) FILTER (WHERE quality IS NULL OR quality NOT IN (1)) AS notins,
  count(*) FILTER (WHERE quality IS NULL) AS nulls, count(*) FILTER (WHERE quality IS NOT NULL) AS notnulls, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS empties,
  count(*) FILTER (WHERE contains(lower(lang), 'e')) AS holds, count(*) FILTER (WHERE lang IS NULL OR NOT lower(lang) LIKE 'e_') AS notlikes,
  count(*) FILTER (WHERE regexp_matches(lang, '^d', 'i')) AS matches, count(*) FILTER (WHERE quality BETWEEN 0 AND 1) AS betweens,
  count(*) FILTER (WHERE doc_id < 10.5) AS below, count(*) FILTER (WHERE doc_id = 10.5) AS never, count(*) FILTER (WHERE quality IS NULL OR quality <> 0.5) AS always,
  count(*) FILTER (WHERE doc_id IN (9, 10.5, 11)) AS held, count(*) FILTER (WHERE doc_id BETWEEN 9.5 AND 40.5) AS within FROM {_LABELLED}""")
def document_filters(t):
    return _counts(_labelled(t), v.document_filter, {
        "eq": Filter("quality", "=", 1), "ne": Filter("quality", "!=", 1), "gt": Filter("quality", ">", 0),
        "ins": Filter("quality", "in", values=[1]), "notins": Filter("quality", "notin", values=[1]),
        "nulls": Filter("quality", "null"), "notnulls": Filter("quality", "notnull"), "empties": Filter("lang", "empty"),
        "holds": Filter("lang", "contains", "E"), "notlikes": Filter("lang", "notlike", "E_"),
        "matches": Filter("lang", "regexp", "^D"), "betweens": Filter("quality", "between", values=[0, 1]),
        "below": Filter("doc_id", "<", 10.5), "never": Filter("doc_id", "=", "10.5"), "always": Filter("quality", "!=", "0.5"),
        "held": Filter("doc_id", "in", values=["9", 10.5, 11]), "within": Filter("doc_id", "between", values=[9.5, "40.5"])})


@query("document_rows", f"""SELECT * FROM {_LABELLED} WHERE (toxic IS NULL OR toxic <> 1)
  AND (contains(lower(lang), 'de') OR contains(lower(source), 'de'))""")
def document_rows(t):
    df = _labelled(t)
    return b.narrow(df, [Filter("toxic", "!=", 1)], "DE", compile_filter=v.document_filter, compile_search=v.document_search)


_WORDS = "(' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


@query("search_index_filters", f"""SELECT count(*) FILTER (WHERE lang = 'en') AS term, count(*) FILTER (WHERE NOT coalesce(lang = 'en', false)) AS not_term,
  count(*) FILTER (WHERE contains({_WORDS.format("text")}, ' that and ')) AS phrase, count(*) FILTER (WHERE contains({_WORDS.format("text")}, ' der d')) AS prefix,
  count(*) FILTER (WHERE starts_with(lower(source), 'w')) AS starts, count(*) FILTER (WHERE NOT coalesce(lower(source) LIKE 'w%', false)) AS notlikes,
  count(*) FILTER (WHERE regexp_full_match(lang, 'e[ns]')) AS anchored, count(*) FILTER (WHERE quality IS NULL) AS missing, count(*) FILTER (WHERE n_chars >= 500) AS ranged,
  count(*) FILTER (WHERE n_chars > 500.5) AS above, count(*) FILTER (WHERE n_chars = 500.5) AS never, count(*) FILTER (WHERE n_chars BETWEEN 99.5 AND 500.5) AS within,
  count(*) FILTER (WHERE NOT coalesce(quality IN (0.5, 1), false)) AS notins FROM (SELECT d.*, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def search_index_filters(t):
    df = v.as_text_field(t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "text")
    return _counts(df, v.search_index_filter, {
        "term": Filter("lang", "=", "en"), "not_term": Filter("lang", "!=", "en"), "phrase": Filter("text", "contains", "That, and"),
        "prefix": Filter("text", "startswith", "der D"), "starts": Filter("source", "startswith", "W"),
        "notlikes": Filter("source", "notlike", "W%"), "anchored": Filter("lang", "regexp", "e[ns]"),
        "missing": Filter("quality", "null"), "ranged": Filter("n_chars", ">=", 500), "above": Filter("n_chars", ">", "500.5"),
        "never": Filter("n_chars", "=", "500.5"), "within": Filter("n_chars", "between", values=[99.5, 500.5]),
        "notins": Filter("quality", "notin", values=[0.5, 1])})


@query("search_index_rows", f"""SELECT doc_id, lang FROM documents WHERE lang <> 'en'
  AND (contains({_WORDS.format("text")}, ' der ') OR lang = 'der' OR source = 'der')
  AND (contains({_WORDS.format("text")}, ' die ') OR lang = 'die' OR source = 'die')""")
def search_index_rows(t):
    df = v.as_text_field(t.documents, "text")
    return b.narrow(df, [Filter("lang", "!=", "en")], "der die", compile_filter=v.search_index_filter,
                    compile_search=v.search_index_search).select("doc_id", "lang")


def _items(t):
    """Orders as items: a set of tags, and an attribute some lack."""
    return t.orders.select(
        "o_orderkey", "o_orderstatus", "o_totalprice",
        F.split("o_orderpriority", "-").alias("tags"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))


_ITEMS = """(SELECT o_orderkey, o_orderstatus, o_totalprice, string_split(o_orderpriority, '-') AS tags,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note FROM orders)"""


@query("item_filters", f"""SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS eq, count(*) FILTER (WHERE coalesce(note <> '5-LOW', true)) AS ne,
  count(*) FILTER (WHERE coalesce(starts_with(note, '5-L'), false)) AS starts, count(*) FILTER (WHERE coalesce(starts_with(note, '5-l'), false)) AS starts_case,
  count(*) FILTER (WHERE list_contains(tags, 'LOW')) AS element, count(*) FILTER (WHERE coalesce(contains(note, 'MED'), false)) AS holds,
  count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS ins, count(*) FILTER (WHERE NOT coalesce(note IN ('5-LOW'), false)) AS notins,
  count(*) FILTER (WHERE note IS NULL) AS nulls, count(*) FILTER (WHERE note IS NOT NULL) AS notnulls, count(*) FILTER (WHERE o_totalprice BETWEEN 100 AND 60000) AS betweens,
  count(*) FILTER (WHERE o_orderkey < 10.5) AS below, count(*) FILTER (WHERE o_orderkey = 10.5) AS never, count(*) FILTER (WHERE o_orderkey IN (9, 10.5)) AS held,
  count(*) FILTER (WHERE o_orderkey <> 10.5) AS always FROM {_ITEMS}""")
def item_filters(t):
    return _counts(_items(t), v.item_filter, {
        "eq": Filter("o_orderstatus", "=", "F"), "ne": Filter("note", "!=", "5-LOW"), "starts": Filter("note", "startswith", "5-L"),
        "starts_case": Filter("note", "startswith", "5-l"), "element": Filter("tags", "contains", "LOW"),
        "holds": Filter("note", "contains", "MED"), "ins": Filter("o_orderstatus", "in", values=["F", "O"]),
        "notins": Filter("note", "notin", values=["5-LOW"]), "nulls": Filter("note", "null"), "notnulls": Filter("note", "notnull"),
        "betweens": Filter("o_totalprice", "between", values=[100, 60000]), "below": Filter("o_orderkey", "<", 10.5),
        "never": Filter("o_orderkey", "=", "10.5"), "held": Filter("o_orderkey", "in", values=[9, 10.5]), "always": Filter("o_orderkey", "!=", 10.5)})


@query("item_search", f"""SELECT o_orderkey, note FROM {_ITEMS} WHERE contains(o_orderstatus, 'LOW') OR list_contains(tags, 'LOW')
  OR coalesce(contains(note, 'LOW'), false)""")
def item_search(t):
    return b.narrow(_items(t), search="LOW", compile_filter=v.item_filter, compile_search=v.item_search).select("o_orderkey", "note")


@query("wide_column_filters", """SELECT count(*) FILTER (WHERE l_orderkey = 7) AS eq, count(*) FILTER (WHERE l_quantity < 10) AS lt,
  count(*) FILTER (WHERE l_quantity >= 5 AND l_quantity <= 9) AS betweens, count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) AS ins,
  count(*) FILTER (WHERE list_contains([l_returnflag, l_linestatus], 'O')) AS element,
  count(*) FILTER (WHERE list_contains([l_returnflag, l_linestatus], 'R')) AS map_value, count(*) FILTER (WHERE l_orderkey <= 10.5) AS below,
  count(*) FILTER (WHERE l_orderkey = 10.5) AS never, count(*) FILTER (WHERE l_linenumber IN (1, 2.5)) AS held,
  count(*) FILTER (WHERE l_orderkey BETWEEN 9.5 AND 40.5) AS within FROM lineitem""")
def wide_column_filters(t):
    df = t.lineitem.withColumn("flags", F.array("l_returnflag", "l_linestatus")).withColumn(
        "attrs", F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus"))
    return _counts(df, v.wide_column_filter, {
        "eq": Filter("l_orderkey", "=", 7), "lt": Filter("l_quantity", "<", 10),
        "betweens": Filter("l_quantity", "between", values=[5, 9]), "ins": Filter("l_returnflag", "in", values=["A", "N"]),
        "element": Filter("flags", "contains", "O"), "map_value": Filter("attrs", "contains", "R"),
        "below": Filter("l_orderkey", "<=", 10.5), "never": Filter("l_orderkey", "=", "10.5"), "held": Filter("l_linenumber", "in", values=[1, 2.5]),
        "within": Filter("l_orderkey", "between", values=["9.5", 40.5])})


def _kv(t):
    return t.events.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("value"),
                           F.concat_ws(":", "event_type", "user_id").alias("field"))


_KV = """(SELECT event_id AS id, json_extract_string(props, '$.k') AS value, event_type || ':' || CAST(user_id AS VARCHAR) AS field FROM events)"""


@query("key_value_filters", f"""SELECT count(*) FILTER (WHERE CAST(value AS DOUBLE) = 12) AS eq, count(*) FILTER (WHERE CAST(value AS DOUBLE) <> 12) AS ne,
  count(*) FILTER (WHERE CAST(value AS DOUBLE) < 9) AS lt, count(*) FILTER (WHERE CAST(value AS DOUBLE) BETWEEN 5 AND 40) AS betweens, count(*) FILTER (WHERE value IN ('12', '13')) AS ins,
  count(*) FILTER (WHERE value NOT IN ('12', '13')) AS notins, count(*) FILTER (WHERE contains(lower(field), 'view:1')) AS holds,
  count(*) FILTER (WHERE field > 'click:5') AS by_text, count(*) FILTER (WHERE lower(field) LIKE 'err%') AS likes, count(*) FILTER (WHERE false) AS nulls,
  count(*) FILTER (WHERE true) AS notnulls, count(*) FILTER (WHERE value = '') AS empties FROM {_KV}""")
def key_value_filters(t):
    return _counts(_kv(t), v.key_value_filter, {
        "eq": Filter("value", "=", "12.0"), "ne": Filter("value", "!=", "12.0"), "lt": Filter("value", "<", 9),
        "betweens": Filter("value", "between", values=["5", "40"]), "ins": Filter("value", "in", values=["12", "13"]),
        "notins": Filter("value", "notin", values=["12", "13"]), "holds": Filter("field", "contains", "VIEW:1"),
        "by_text": Filter("field", ">", "click:5"), "likes": Filter("field", "like", "ERR%"), "nulls": Filter("value", "null"),
        "notnulls": Filter("value", "notnull"), "empties": Filter("value", "empty")})


@query("key_value_search", f"""SELECT * FROM {_KV} WHERE contains(CAST(id AS VARCHAR), '42') OR contains(value, '42') OR contains(lower(field), '42')""")
def key_value_search(t):
    return b.narrow(_kv(t), search="42", compile_filter=v.key_value_filter, compile_search=v.key_value_search)


@query("flavour_rules", f"""SELECT (SELECT count(*) FROM {_LABELLED} WHERE toxic <> 1) AS relational,
  (SELECT count(*) FROM {_LABELLED} WHERE toxic IS NULL OR toxic <> 1) AS document,
  (SELECT count(*) FROM {_LABELLED} WHERE toxic IS NULL OR toxic <> 1) AS search""")
def flavour_rules(t):
    """The same negation under three rules for missing values."""
    df, f = _labelled(t), Filter("toxic", "!=", 1)
    rules = {"relational": b.predicate, "document": v.document_filter, "search": v.search_index_filter}
    return df.agg(*[F.count_if(rule(df, f)).alias(n) for n, rule in rules.items()])


