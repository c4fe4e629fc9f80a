"""The registered queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.chat import read_chats, write_chats
from tabloom.llm.collocations import LONGEST, MIN_COUNT, TOP, collocations
from tabloom.llm.common import TOKEN_SQL, WORD_SQL, prepare
from tabloom.llm.decontaminate import WINDOW, find_benchmarks
from tabloom.llm import importance
from tabloom.llm.licenses import scan_licenses
from tabloom.llm import mixing
from tabloom.llm.near import near_duplicates
from tabloom.llm.packing import pack
from tabloom.llm.passages import repeated_passages
from tabloom.llm.planes import read_documents, write_ids
from tabloom.llm.quality import (DULL_WORDS, MAX_LOSS, MAX_REPEAT, MIN_WORDS, NOTICE_WORDS, NOTICES, SEPARATORS, SHOUT_WORDS,
                                 TERMINAL, judge_documents)
from tabloom.llm.shards import shuffle_into_shards
from tabloom.llm.wrappers import extract_pages
from tabloom.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Lower-case A-Z, and no other letter, in SQL.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("op1_decontaminate", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD_SQL}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
      regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD_SQL}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM d, (SELECT DISTINCT k FROM iw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT rid, i, k, item FROM dw JOIN iw USING (k, win)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS u(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha
        FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN its USING (rid)""")
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_benchmarks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).drop("spans")


@query("op9_quality", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS w FROM documents),
tri AS (SELECT rid, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS win FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 3)) AS u(p) GROUP BY rid),
lines AS (SELECT rid, i, ls[i] AS line, regexp_extract_all(ls[i], '{TOKEN_SQL}') AS lw
          FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS t(i)),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM lines WHERE len(lw) > 0 GROUP BY rid, line)
        GROUP BY rid),
hard AS (SELECT *, len(lw) > 0 AND (
    5 * len([x FOR x IN lw IF x IN ({_strings(SEPARATORS)})]) >= len(lw)
    OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))
    OR (len(lw) >= {SHOUT_WORDS} AND len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]')))
    OR (len(lw) >= {DULL_WORDS} AND 5 * len(list_distinct(lw)) < len(lw))) AS hard,
    len([x FOR x IN lw IF {" OR ".join(f"ends_with(x, {_strings([t])})" for t in TERMINAL)}]) = 0 AS dry,
    len(lw) > 0 AND ({" OR ".join(f"ends_with(lw[len(lw)], {_strings([t])})" for t in TERMINAL)}) AS ends,
    len(lw) <= {NOTICE_WORDS} AND regexp_matches({_LOWER.format('line')},
        '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])({"|".join(NOTICES)})($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])') AS notice FROM lines),
own AS (SELECT *, len(lw) > 0 AND NOT hard AND (dry OR NOT notice) AS part FROM hard),
joined AS (SELECT *, part AND coalesce(lag(part AND NOT ends) OVER (PARTITION BY rid ORDER BY i), false) AS goes_on FROM own),
unit AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS unit FROM joined),
told AS (SELECT *, bool_or(part AND NOT dry) OVER (PARTITION BY rid, unit) AS marked FROM unit),
bad AS (SELECT rid, sum(len(lw)) AS n FROM told WHERE len(lw) > 0 AND (
    hard OR (NOT dry AND notice) OR (dry AND (NOT marked OR notice))) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(bad.n, 0) AS BIGINT) AS n_bad_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN bad USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_words, base_failed,
       NOT base_failed AND 100 * n_bad_words <= {MAX_LOSS} * n_words AS kept FROM j""")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_documents(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_words", "base_failed", "kept")


@query("op3_shards")
def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shuffle_into_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_id_planes")
def op4_id_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(prepare(spark), "id-planes")
    write_ids(table(spark, folder, "documents"), path)
    return read_documents(spark, path)


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


# A conversation whose texts hold the template's own marks.
_MARKED = """SELECT -1L AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


@query("op5_chat")
def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(prepare(spark), "chats")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    write_chats(turns.unionByName(spark.sql(_MARKED)), path)
    return read_chats(spark, path).drop("n_tokens", "loss_tokens")


@query("op8_passages")
def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


@query("op7_pages")
def op7_pages(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


# CRC-32 of a word's bytes, a byte at a time by a table that SQL makes too; ``i`` are words.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(encode(w)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)
    FOR i IN range(1, strlen(w) + 1)]), lambda c, x: xor(c >> 8, t[xor(c, x) & 255 + 1])), 4294967295)""".replace(
    "t[xor(c, x) & 255 + 1]", "t[(xor(c, x) & 255) + 1]")


@query("op11_importance", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD_SQL}') AS ws FROM documents),
dw AS (SELECT rid, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD_SQL}')) AS w FROM benchmark),
crc AS (SELECT w, {_CRC} % {importance.BUCKETS} AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
        ({_CRC_TABLE})),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM dw) + {importance.BUCKETS})
        / ((CAST(s AS DOUBLE) + 1) * ((SELECT count(*) FROM bw) + {importance.BUCKETS})))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
               AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN sums USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {importance.MIN_WORDS}
          ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance.MIN_WORDS}
    AND place <= {importance.PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {importance.MIN_WORDS}) // 100 THEN place END AS rank FROM r""")
def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_mixing", f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS BIGINT) AS size,
           (CAST('0x' || substr(sha256('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT)
            + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw FROM documents),
c AS (SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {mixing.MOST} * CAST(sum(size) AS BIGINT) AS cap,
      CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS DOUBLE) AS weight FROM d GROUP BY source),
l AS (SELECT *, ((SELECT CAST(sum(size) AS DOUBLE) FROM d) * 100 / 100.0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
tg AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE))) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tg),
p2 AS (SELECT *, target - whole * source_size AS rest FROM p),
k AS (SELECT c.source, class, sum(size) AS x, CAST(sum(CAST(size AS HUGEINT) * size) AS DOUBLE) AS xx, max(size) AS top, any_value(rest) AS rest
      FROM c JOIN p2 ON c.source IS NOT DISTINCT FROM p2.source WHERE size > 0 GROUP BY c.source, class),
k2 AS (SELECT *, greatest((rest - CAST(coalesce(sum(x) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
       / sum(xx) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS rate FROM k),
e AS (SELECT source, coalesce(max(class) FILTER (rate * top <= 1), min(class)) AS edge,
      coalesce(arg_max(rate, class) FILTER (rate * top <= 1), arg_min(rate, class)) AS rate FROM k2 GROUP BY source),
q AS (SELECT doc_id, c.source, size, class > edge AS certain, least(rate * size, {mixing.NEARLY!r}::DOUBLE) AS chance, draw, whole, rest, source_size, target
      FROM c JOIN p2 ON c.source IS NOT DISTINCT FROM p2.source LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source),
z AS (SELECT *, CASE WHEN size = 0 THEN 1.0::DOUBLE WHEN certain THEN -1.0::DOUBLE
      ELSE draw * (1 - chance) / (draw * (1 - chance) + (1 - draw) * chance) END AS place FROM q),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT doc_id, source, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o""")
def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def _collocation_sql(min_count: int = MIN_COUNT, n: int = TOP, longest: int = LONGEST) -> str:
    return f"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM p, range(1, {longest + 1}) AS ms(m), unnest(range(1, len(w) - m + 2)) AS t(i)),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= {min_count}),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT c.lang, c.phrase, a, k, h.f AS l, r.f AS r, n, (1000 * a * n) // (h.f * r.f) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c JOIN total USING (lang)
        JOIN f AS h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[:k], ' ')
        JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + j - 1], ' ') AS phrase, a AS longer
         FROM c, range(2, {longest}) AS js(j), unnest(range(1, m - j + 2)) AS t(i) WHERE j < m),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = b.lang AND part.phrase = b.phrase AND 100 * longer >= 100 * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score FROM o WHERE rank <= {n}"""


@query("op13_collocations", _collocation_sql())
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
