"""Benchmark decontamination: a prefix-filtered join of word windows.

Each benchmark window is filed under its rarest word, rarity being the word's
count over all documents: a text that holds the window must hold that word at
the window's offset. Occurrences of such words in documents are the only
candidates. A candidate must leave room for the whole window before and after
it, the hashes of the words beside it must agree, and the words in place are then
compared exactly.

DataFrame expressions only, and one plan at every size: the windows are rows of
hashes, of a fixed width, and at most ``BROADCAST_ROWS`` of them are broadcast at a
time, with one pass over the texts for each such chunk; no row for each word of a
text is ever shuffled. The texts are split once to count the words that windows have,
once to find occurrences, and once to count words.

Defined cases: null or wordless texts have no words, hit nothing and are hit by
nothing; items with the same windows are all named; items of null id take no
part; rows with the same id and text get the same result, each row once; rows
with one id and different texts are judged apart; extra columns of any name are
kept by ``decontaminate`` and ignored by ``contamination``; long texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_az, materialize, table

#: What separates words; A-Z are left in place, and lower-cased later.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of about 60 bytes.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window array, wid) of every item."""
    w = items.where("item_id IS NOT NULL").select("item_id", words(lower_az(F.col("text"))).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(width))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    out = w.select("item_id", "w", size.alias("len"), at.alias("at")).select("item_id", F.slice("w", F.col("at"), F.col("len")).alias("window"))
    return out.withColumn("wid", F.md5(F.array_join("window", " "))).distinct()


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def neighbour(w: str, at: Column) -> Column:
    """Hash of the word at a place from 0; null outside."""
    word = F.get(w, at)
    return F.when(word.isNotNull(), word_hash(word))


def in_chunks(small: DataFrame, key: str, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of joins with a table of fixed-width rows, so many of which are
    broadcast at a time; one pass for each chunk, mostly one."""
    n = max(1, -(-small.count() // BROADCAST_ROWS))
    return reduce(DataFrame.union, [join(F.broadcast(small.where(F.pmod(F.xxhash64(key), F.lit(n)) == i))) for i in range(n)])


def prefix_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, back, len, wid, before, after): each distinct window under the hash of
    its rarest word, ``back`` words after its start, with hashes of the words on
    either side. Windows with a word that no document has are gone."""
    each = windows.dropDuplicates(["wid"])
    parts = each.select("wid", F.posexplode("window").alias("back", "token")).withColumn("word", word_hash(F.col("token")))
    asked = materialize(parts.select("word").distinct())
    tokens = docs.select(F.explode_outer(words(F.col("text"))).alias("token")).select(word_hash(F.col("token")).alias("word"))
    counts = in_chunks(asked, "word", lambda some: tokens.join(some, "word").groupBy("word").agg(F.count("*").alias("n")))
    ranked = parts.join(counts, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "word", "back")).alias("best"))
    back = F.col("best.back")
    return ranked.where("best.n > 0").join(each, "wid").select(
        "wid", "best.word", "best.back", F.size("window").alias("len"), neighbour("window", back - 1).alias("before"), neighbour("window", back + 1).alias("after")
    )


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, h, start, stop, wid) of every window in a document. Where the hashes
    of the rarest word and its neighbours agree and there is room for the window, the
    words in place are taken along and compared with it. Outer generators, as inner
    ones get a size filter that splits the text twice."""
    index = materialize(prefix_index(docs, windows))
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    tokens = split.select("doc_id", "h", "w", F.posexplode_outer("w").alias("pos", "token")).withColumn("word", word_hash(F.col("token")))
    start = F.col("pos") - F.col("back")
    same = lambda x, place: F.col(x).isNull() | (F.col(x) == neighbour("w", place))
    fits = (start >= 0) & (start + F.col("len") <= F.size("w")) & same("before", F.col("pos") - 1) & same("after", F.col("pos") + 1)
    found = lower_az(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")), " "))
    maybe = in_chunks(index, "word", lambda some: tokens.join(some, "word").where(fits).select("doc_id", "h", start.alias("start"), (start + F.col("len")).alias("stop"), "wid", found.alias("found")))
    phrases = windows.select(F.col("wid"), F.array_join("window", " ").alias("phrase")).dropDuplicates(["wid"])
    return materialize(maybe.distinct()).join(phrases, "wid").where("found = phrase").select("doc_id", "h", "start", "stop", "wid")


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, stop) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, n_hit, n_items,
    items_sha256, contaminated, items, and h, the hash of the text."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    windows = materialize(benchmark_windows(items, width))
    hits = materialize(occurrences(docs, windows))
    names = windows.select("wid", F.col("item_id").cast("string").alias("item"))
    named = hits.select("doc_id", "h", "wid").distinct().join(names, "wid").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("names"))
    spans = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), covered(F.col("spans")).cast("long").alias("n_hit"))
    per_doc = materialize(named.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("d", "g", "n_hit", "names"))
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit, items_of = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("names", F.array().cast("array<string>"))
    return base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), items_of.alias("items"), "h",
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, whose text holds no
    benchmark window."""
    hits = occurrences(docs.select("doc_id", "text"), materialize(benchmark_windows(items.select("item_id", "text"), width)))
    bad = materialize(hits.select("doc_id", "h").distinct())  # read from a table: no name of it can be meant by one of docs
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["h"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "h")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS p
       FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS p
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, s, l, item_id FROM dw JOIN bw USING (l, p)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
