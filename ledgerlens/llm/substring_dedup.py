"""Removal of repeated word windows by difference-cover anchors.

A window of ``width`` words is a repeat if the same words start earlier; words
in any repeat go. Hashing every window would shuffle a row for each word, so:

1. Short anchors are hashed only where the position in the document, modulo the
   period, lies in a difference cover. Two equal windows share an aligned anchor
   whatever their positions, as for any two residues some shift below the period
   puts both into the cover, and anchor + period - 1 <= width.
2. Anchors that occur again anywhere give the candidate windows: those that
   contain one.
3. Candidates alone are hashed whole, with 128 bits, and all but the first of
   each kind are repeats.

In 1 and 3 a task keeps one row of each hash that it sees and settles the others
itself, so a passage copied a million times is as many rows in the shuffle as
there are tasks. Groups are read from sorted partitions as a stream. Nothing is
collected.

Defined cases: null, empty and short texts have no windows; rows of the same id
and text are one document, null ids come last (see ``keyed``); windows that
overlap their own earlier copy count as repeats; other columns are kept, whatever
their names; long texts are read whole, in slices that hold one text at least.

Windows are told apart by 128 bits, made of two 64-bit hashes of each word: equal
windows are always found, and different ones are taken for equal only if both hashes
agree for all that differs, which isn't checked against the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed, materialize, merged_runs, mix, packed_spans, plain_names, ship, sorted_groups, span_mask, starts_inside, table, text_slices, window_hashes, word_hashes, words_of

WIDTH = 20
#: Every difference modulo 13 is one of two members of {0, 1, 3, 9}.
PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8
ROWS_AT_ONCE = 600_000
SECOND_BASE = 0xD6E8FEB86659FD93
KEY = "__key"


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Pool:
    """Arrays that pile up until there are enough to settle together."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.rows = most, [], 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.rows += len(arrays[0])
        return self.rows >= self.most

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.rows = [], 0
        return out


def _anchor_rows(h: np.ndarray, key: np.ndarray, pos: np.ndarray, back: int):
    """Of anchors seen together: one row of each hash (stop -1, or -2 if it is
    settled that it occurs again), and the spans of settled window starts."""
    order = np.argsort(h, kind="stable")
    h, key, pos = h[order], key[order], pos[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    again = ~first | np.concatenate([~first[1:], [False]])
    k, lo, hi = merged_runs(key[again], np.maximum(pos[again] - back, 0), pos[again] + 1)
    out_h = np.concatenate([h[first], mix(k.view(U64) ^ U64(0xA5A5A5A5))])
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(out_h)), pa.array(np.concatenate([key[first], k])), pa.array(np.concatenate([pos[first], lo]).astype(np.int32)),
         pa.array(np.concatenate([np.where(again[first], -2, -1), hi]).astype(np.int32))],
        ["h", "k", "pos", "stop"],
    )


def candidates(docs: DataFrame, width: int, period: int, cover: tuple[int, ...], anchor: int) -> DataFrame:
    """docs(__key, text): (__k, __spans) with the starts of candidate windows."""
    back = width - anchor
    inside = np.isin(np.arange(period), cover)

    def emit(batches):
        pool = Pool(ROWS_AT_ONCE)
        for batch in batches:
            for part in text_slices([batch]):
                flat, offsets = words_of(part.column("text"), lower=False)
                h = window_hashes(word_hashes(flat), anchor)
                where, row, local = starts_inside(offsets, anchor)
                use = inside[local % period] & (np.diff(offsets)[row] >= width)
                if pool.add(h[where[use]], part.column(KEY).to_numpy()[row[use]], local[use]):
                    yield _anchor_rows(*pool.take(), back)
        if pool.rows:
            yield _anchor_rows(*pool.take(), back)

    def meet(batches):
        for group in sorted_groups(batches, ["h"]):
            h, k, pos, stop = (group.column(c).to_numpy() for c in ("h", "k", "pos", "stop"))
            own = stop < 0
            done = pa.RecordBatch.from_arrays([pa.array(k[~own]), pa.array(packed_spans(pos[~own], stop[~own]))], ["k", "span"])
            if done.num_rows:
                yield done
            h, k, pos, stop = h[own], k[own], pos[own], stop[own]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            again = (np.concatenate([same, [False]]) | np.concatenate([[False], same])) & (stop == -1)
            if again.any():
                k, lo, hi = merged_runs(k[again], np.maximum(pos[again] - back, 0), pos[again] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(packed_spans(lo, hi))], ["k", "span"])

    rows = docs.select(KEY, "text").mapInArrow(emit, "h long, k long, pos int, stop int")
    spans = rows.repartition("h").sortWithinPartitions("h").mapInArrow(meet, "k long, span long")
    return spans.groupBy(F.col("k").alias("__k")).agg(F.collect_list("span").alias("__spans"))


def _window_rows(a: np.ndarray, b: np.ndarray, key: np.ndarray, pos: np.ndarray, width: int):
    """Of windows seen together: the first of each kind, and the spans of words
    in the others."""
    order = np.lexsort((pos, key, b, a))
    a, b, key, pos = a[order], b[order], key[order], pos[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    late = (key != key[head]) | (pos != pos[head])  # a row read twice is no repeat
    k, lo, hi = merged_runs(key[late], pos[late], pos[late] + width)
    n = len(k)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.concatenate([a[first], mix(k.view(U64) ^ U64(0xA5A5A5A5))]))), pa.array(signed(np.concatenate([b[first], np.zeros(n, U64)]))),
         pa.array(np.concatenate([key[first], k])), pa.array(np.concatenate([pos[first], lo]).astype(np.int32)),
         pa.array(np.concatenate([np.full(first.sum(), -1), hi]).astype(np.int32))],
        ["a", "b", "k", "pos", "stop"],
    )


def repeats(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(__k, __spans) with the words of each document that go."""

    def emit(batches):
        pool = Pool(ROWS_AT_ONCE)
        for batch in batches:
            for part in text_slices([batch]):
                flat, offsets = words_of(part.column("text"), lower=False)
                if len(flat) < width:
                    continue
                h = word_hashes(flat)
                a, b = window_hashes(h, width), window_hashes(mix(h ^ U64(0x5851F42D4C957F2D)), width, SECOND_BASE)
                where, row, local = starts_inside(offsets, width)
                spans = part.column("__spans")
                masks = [span_mask(np.asarray(spans[r].values), max(0, int(n) - width + 1)) for r, n in enumerate(np.diff(offsets))]
                use = np.concatenate(masks)
                where, row, local = where[use], row[use], local[use]
                if pool.add(a[where], b[where], part.column(KEY).to_numpy()[row], local):
                    yield _window_rows(*pool.take(), width)
        if pool.rows:
            yield _window_rows(*pool.take(), width)

    def meet(batches):
        for group in sorted_groups(batches, ["a"]):
            a, b, k, pos, stop = (group.column(c).to_numpy() for c in ("a", "b", "k", "pos", "stop"))
            own = stop < 0
            keep_k, lo, hi = k[~own], pos[~own], stop[~own]
            a, b, k, pos = a[own], b[own], k[own], pos[own]
            if len(a):
                start = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                head = np.flatnonzero(start)[np.cumsum(start) - 1]
                late = (k != k[head]) | (pos != pos[head])
                keep_k, lo, hi = np.concatenate([keep_k, k[late]]), np.concatenate([lo, pos[late]]), np.concatenate([hi, pos[late] + width])
            if len(keep_k):
                keep_k, lo, hi = merged_runs(keep_k, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(keep_k), pa.array(packed_spans(lo, hi))], ["k", "span"])

    both = docs.join(found, docs[KEY] == found["__k"]).drop("__k")
    rows = both.mapInArrow(emit, "a long, b long, k long, pos int, stop int")
    spans = rows.repartition("a").sortWithinPartitions("a", "b", "k", "pos").mapInArrow(meet, "k long, span long")
    return spans.groupBy(F.col("k").alias("__k")).agg(F.collect_list("span").alias("__spans"))


def _kept(part: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[str]]:
    """Words, removed words and kept text of each row (column __spans may be null)."""
    flat, offsets = words_of(part.column("text"), lower=False)
    counts, removed, texts = np.diff(offsets), [], []
    spans = part.column("__spans")
    for r, (s, n) in enumerate(zip(offsets, counts)):
        own = flat.slice(s, n)
        if spans[r].is_valid:
            gone = span_mask(np.asarray(spans[r].values), int(n))
            removed.append(int(gone.sum()))
            own = own.filter(pa.array(~gone))
        else:
            removed.append(0)
        texts.append(" ".join(own.to_pylist()))
    return counts, removed, texts


def _joined(docs: DataFrame, width: int) -> DataFrame:
    if ANCHOR + PERIOD - 1 > width:
        raise ValueError(f"windows of at least {ANCHOR + PERIOD - 1} words")
    ship(docs.sparkSession)
    base, _ = keyed(docs, KEY)
    # both joins take the same columns, so that the texts are shuffled once
    gone = repeats(base, materialize(candidates(base, width, PERIOD, COVER, ANCHOR)), width)
    return base.join(gone, base[KEY] == gone["__k"], "left").drop("__k", KEY)


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256."""

    def run(batches):
        for batch in batches:
            for part in text_slices([batch]):
                counts, removed, texts = _kept(part)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                })

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string"
    return _joined(docs.select("doc_id", "text"), width).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all rows and columns; texts that lose words become their kept words
    joined by a space (n_chars, if there, follows), others stay as they are."""
    wide = plain_names(docs)
    names = wide.columns
    chars = next((wide.columns[i] for i, n in enumerate(docs.columns) if n == "n_chars"), None)

    def run(batches):
        for batch in batches:
            for part in text_slices([batch]):
                old = part.column("text").to_pylist()
                _, removed, texts = _kept(part)
                new = [t if n else o for t, n, o in zip(texts, removed, old)]
                columns = {c: part.column(c) for c in names}
                columns["text"] = pa.array(new, pa.string())
                if chars:
                    sizes = [len(t) if n else o for t, n, o in zip(texts, removed, part.column(chars).to_pylist())]
                    columns[chars] = pa.array(sizes, part.column(chars).type)
                yield pa.RecordBatch.from_pydict(columns)

    return _joined(wide, width).mapInArrow(run, wide.schema).toDF(*docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late),
ow AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM ow ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
