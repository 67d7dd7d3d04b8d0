"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased runs of letters. A bounded sample of labelled rows
(``sample_rows`` on average, by hash) gives the examples; all their terms count.
A term's weight in a text is (1 + log count) * idf * relevance: inverse document
frequencies are counted over all documents, and the relevance is the square root of
the term's likelihood ratio between toxic and other examples (plus a small constant,
so that no term is dropped), as plain idf finds texts of like topic and not of like
tone. Terms that no example has are orthogonal to all of them and left out.

The examples form an inverted index in blocks of ``BLOCK`` with each term's largest
weight by block; like examples lie side by side. A batch of texts adds up these
maxima, visits each text's most promising blocks, and then those alone whose bound
reaches its k-th best cosine, so the k nearest are exact. Votes weighted by cosine
and shrunk to the base rate are mapped to a probability by a logistic curve, which
is fitted to the votes that every example gets from the others.

Defined cases: null, empty and wordless texts have no term and get the score of the
bare base rate; null labels and ids are not learned from; of several labels for one
id the largest counts; without labels the score is 0; ties in cosine go to the
smaller example id; repeated rows are scored alike; long texts are scored whole;
other columns, whatever their names, are kept by ``keep_clean`` and ignored by
``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh, give_back, ship, table, text_slices, word_hashes, words_of

BLOCK, FIRST, AT_ONCE, DENSE = 256, 4, 128, 512
#: Added to every term's likelihood ratio.
LEAST_RELEVANCE = 0.01


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return words_of(pc.replace_substring_regex(pc.utf8_lower(fresh(texts)), r"[^\p{L}\p{M}]+", " "), lower=False)


class Terms:
    """Terms to look up by sorted hash; what is found is compared as text."""

    def __init__(self, terms: list[str] | pa.Array) -> None:
        self.values = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.large_string())
        hashes = word_hashes(self.values)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def __reduce__(self):
        return Terms, (self.values,)

    def __len__(self) -> int:
        return len(self.values)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the terms in the texts, sorted by row and term."""
        flat, offsets = term_lists(texts)
        coded, size = flat.dictionary_encode(), max(1, len(self))
        each = coded.dictionary
        place = np.full(len(each), -1)
        if len(self) and len(each):
            near = self.order[np.minimum(np.searchsorted(self.hashes, word_hashes(each)), len(self) - 1)]
            same = pc.equal(self.values.take(pa.array(near)), each.cast(pa.large_string())).to_numpy(zero_copy_only=False)
            place[same] = near[same]
        found = place[coded.indices.to_numpy()]
        at = np.flatnonzero(found >= 0)
        key, n = np.unique((np.searchsorted(offsets, at, side="right") - 1) * size + found[at], return_counts=True)
        return key // size, key % size, n


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the range of each."""
    size = stops - starts
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(ends[-1] if len(ends) else 0) + (starts - (ends - size))[of], of


def alike(matrix: np.ndarray, rows: np.ndarray) -> list[int]:
    """The rows in an order that puts like beside like: halved along the direction in
    which they differ most, down to blocks."""
    if len(rows) <= BLOCK or not matrix.shape[1]:
        return rows.tolist()
    x = matrix[rows] - matrix[rows].mean(0)
    way = np.abs(x).sum(0)
    for _ in range(12):
        way = x.T @ (x @ way)
        way /= np.linalg.norm(way) or 1.0
    order = rows[np.argsort(x @ way, kind="stable")]
    half = -(-len(rows) // BLOCK) // 2 * BLOCK
    return alike(matrix, order[:half]) + alike(matrix, order[half:])


class BlockMaxIndex:
    """Unit vectors of examples as postings by term; the postings of one term and
    block are a cell with its largest weight. Rows are renumbered so that blocks,
    runs of rows, hold examples alike in their frequent terms. Cells of the ``DENSE``
    most frequent terms are stored as matrices, one a block, the others as lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> None:
        weights = weights / np.sqrt(np.bincount(rows, weights**2, len(ids)))[rows]
        df = np.bincount(terms, minlength=n_terms)
        common = np.argsort(-df, kind="stable")[:DENSE]
        self.common = common[df[common] * 16 >= len(ids)]
        place = np.full(n_terms, -1)
        place[self.common] = np.arange(len(self.common))
        full = np.flatnonzero(place[terms] >= 0)
        matrix = np.zeros((len(ids), len(self.common)))
        matrix[rows[full], place[terms[full]]] = weights[full]
        by = np.array(alike(matrix, np.argsort(ids, kind="stable")), np.int64)
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids))
        self.ids, self.labels, rows = ids[by], labels[by], place[rows]
        order = np.lexsort((rows, terms))
        self.rows, self.weights, self.df = rows[order].astype(np.int32), weights[order], df.astype(np.int32)
        self._cells()

    def _cells(self) -> None:
        """What follows from the postings; it isn't sent along."""
        n_terms, terms = len(self.df), np.repeat(np.arange(len(self.df)), self.df)
        self.blocks = -(-len(self.ids) // BLOCK)
        cell = terms * self.blocks + self.rows // BLOCK
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        self.edges = np.concatenate([head, [len(cell)]])
        self.block = cell[head] % max(1, self.blocks)
        self.top = np.maximum.reduceat(self.weights, head) if len(head) else np.empty(0)
        self.starts = np.searchsorted(cell[head] // max(1, self.blocks), np.arange(n_terms + 1))
        self.place = np.full(n_terms, -1)
        self.place[self.common] = np.arange(len(self.common))
        at = self.place[terms]
        full = np.flatnonzero(at >= 0)
        self.dense = np.zeros((self.blocks, len(self.common), BLOCK))
        self.dense[self.rows[full] // BLOCK, at[full], self.rows[full] % BLOCK] = self.weights[full]

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ids", "labels", "rows", "weights", "df", "common")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._cells()

    def nearest(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For texts with terms[at[i]:at[i + 1]]: positions and cosines of the k
        nearest examples, nearest first; cosine 0 where there are fewer with a
        common term. ``but`` names a row for each text that isn't its neighbour."""
        n, size, wide = len(at) - 1, len(self.ids), self.blocks * BLOCK
        norm = np.sqrt(np.add.reduceat(np.append(weights**2, 0.0), at[:-1]) * (np.diff(at) > 0))
        text = np.repeat(np.arange(n), np.diff(at))
        weights = weights / norm[text]
        cells, of = spread(self.starts[terms], self.starts[terms + 1])
        owner, weight, block = text[of], weights[of], self.block[cells]
        bound = np.bincount(owner * self.blocks + block, weight * self.top[cells], n * self.blocks).reshape(n, self.blocks)
        common = self.place[terms]
        full = np.flatnonzero(common >= 0)
        asked = np.zeros((n, self.dense.shape[1]))
        asked[text[full], common[full]] = weights[full]
        rare = np.flatnonzero(common[of] < 0)
        cells, owner, weight, block = cells[rare], owner[rare], weight[rare], block[rare]
        sums, kept = np.zeros((n, wide)), min(k, size)

        def visit(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)):
                rows = np.flatnonzero(which[:, b])
                sums[rows, b * BLOCK : (b + 1) * BLOCK] += asked[rows] @ self.dense[b]
            use = np.flatnonzero(which[owner, block])
            start, stop = self.edges[cells[use]], self.edges[cells[use] + 1]
            found, _ = spread(start, stop)
            key = np.repeat(owner[use] * wide, stop - start) + self.rows[found]
            np.add(sums.ravel(), np.bincount(key, np.repeat(weight[use], stop - start) * self.weights[found], n * wide), out=sums.reshape(-1))
            if but is not None:
                sums[np.arange(n), but] = 0.0

        top = np.argsort(-bound, 1, kind="stable")[:, :FIRST]
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, top, True, 1)
        visit(first)
        # the k-th best of the first blocks can only rise
        seen = sums.reshape(n, self.blocks, BLOCK)[np.arange(n)[:, None], top].reshape(n, -1)
        least = np.partition(seen, seen.shape[1] - kept, 1)[:, seen.shape[1] - kept] if seen.shape[1] > kept else np.zeros(n)
        visit(~first & (bound > 0) & (bound >= least[:, None] - 1e-9))
        best, cosine = np.zeros((n, kept), np.int64), np.zeros((n, kept))
        for i in range(n):
            near = np.flatnonzero(sums[i] >= max(least[i] - 1e-11, 1e-11))
            score = sums[i][near].round(12)
            order = np.lexsort((self.ids[near], -score))[:kept]
            best[i, : len(order)], cosine[i, : len(order)] = near[order], score[order]
        return best, cosine


def logistic(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from the log-odds of a vote to those of the
    label, by Newton's steps on the likelihood with a little decay."""
    x = np.stack([odds(votes), np.ones(len(votes))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * (w - (1.0, 0.0)))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    def __init__(self, terms: Terms, weight: np.ndarray, index: BlockMaxIndex | None, base: float, k: int, prior: float) -> None:
        self.terms, self.weight, self.index, self.base, self.k, self.prior = terms, weight, index, base, k, prior
        self.curve = (1.0, 0.0)

    def votes(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the vote, its neighbours' positions and cosines."""
        best, cosine = self.index.nearest(at, terms, (1 + np.log(counts)) * self.weight[terms], self.k, but)
        return ((cosine * self.index.labels[best]).sum(1) + self.prior * self.base) / (cosine.sum(1) + self.prior), best, cosine

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the ids of the examples that voted, nearest first."""
        if self.index is None:
            return np.full(len(texts), self.base), [[]] * len(texts)
        row, term, n = self.terms.counts(texts)
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        score, ids = np.empty(len(texts)), []
        for s in range(0, len(texts), AT_ONCE):
            e = min(len(texts), s + AT_ONCE)
            own = slice(at[s], at[e])
            vote, best, cosine = self.votes(at[s : e + 1] - at[s], term[own], n[own])
            score[s:e] = 1 / (1 + np.exp(-(self.curve[0] * odds(vote) + self.curve[1])))
            ids += [self.index.ids[b[c > 0]].tolist() for b, c in zip(best, cosine)]
        return score, ids


def relevance(a: np.ndarray, n: np.ndarray, toxic: float, total: float) -> np.ndarray:
    """By term: from the likelihood ratio of its ``a`` toxic among its n examples
    against the rate of all."""
    p = min(max(toxic / total, 1e-6), 1 - 1e-6)
    side = lambda x, q: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / (n * q)), 0.0)
    return np.sqrt(np.maximum(0.0, 2 * (side(a, p) + side(n - a, 1 - p))) + LEAST_RELEVANCE)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, k: int = 15, prior: float = 0.1) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic). What comes to the driver: the
    sample's terms and its examples' counts of them. Its copies go as soon as they are
    read, and their memory goes back, as the driver has stages after this one to run."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1_000_000)) / 1_000_000
    examples = docs.join(F.broadcast(labels.where(draw < min(1.0, sample_rows / max(1, n)))), "doc_id")

    def vectors(batches):
        for batch in batches:
            for part in text_slices([batch]):
                flat, offsets = term_lists(part.column("text"))
                coded = flat.dictionary_encode()
                size = max(1, len(coded.dictionary))
                key, n = np.unique(np.repeat(np.arange(part.num_rows), np.diff(offsets)) * size + coded.indices.to_numpy(), return_counts=True)
                at = np.searchsorted(key // size, np.arange(part.num_rows + 1)).astype(np.int32)
                terms = coded.dictionary.cast(pa.string()).take(pa.array(key % size))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "terms": pa.ListArray.from_arrays(at, terms), "counts": pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, terms array<string>, counts array<int>"
    full = examples.select("doc_id", "toxic", "text").mapInArrow(vectors, schema).toArrow().combine_chunks()
    if not full.num_rows:
        return Model(Terms([]), np.empty(0), None, 0.0, k, prior)
    order = sorted(range(full.num_rows), key=lambda i, ids=full["doc_id"].to_pylist(): ids[i])
    full = full.take(pa.array(order)).combine_chunks()
    give_back()
    y, keys = full["toxic"].to_numpy() > 0, np.array(full["doc_id"].to_pylist())
    rate = float(y.mean())
    lists = full["terms"].chunk(0)
    rows = np.repeat(np.arange(full.num_rows), np.diff(lists.offsets.to_numpy()))
    count = full["counts"].chunk(0).flatten().to_numpy()
    coded = lists.flatten().dictionary_encode()
    terms, term = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64)
    del full, lists, coded, order
    if not len(terms):
        return Model(Terms([]), np.empty(0), None, rate, k, prior)
    terms = Terms(terms)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def document_frequency(batches):
        known, rows = shared.value, 0
        seen = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for part in text_slices([batch]):
                seen[:-1] += np.bincount(known.counts(part.column("text"))[1], minlength=len(known))
                rows += part.num_rows
        seen[-1] = rows
        used = np.flatnonzero(seen)
        for s in range(0, len(used), 10_000):
            yield pa.RecordBatch.from_pydict({"term": pa.array(used[s : s + 10_000], pa.int32()), "n": seen[used[s : s + 10_000]]})

    df = np.zeros(len(terms) + 1)
    got = docs.mapInArrow(document_frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    shared.destroy()
    del got
    in_toxic, in_any = np.bincount(term[y[rows]], minlength=len(terms)), np.bincount(term, minlength=len(terms))
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * relevance(in_toxic, in_any, y.sum(), len(y))
    # an example without any term has no vector and votes on nothing
    vector = np.unique(rows)
    place = np.searchsorted(vector, rows)
    ids = keys[vector]
    index = BlockMaxIndex(ids, y[vector].astype(float), place, term, (1 + np.log(count)) * weight[term], len(terms))
    give_back()
    model = Model(terms, weight, index, rate, k, prior)
    at = np.searchsorted(place, np.arange(len(vector) + 1))
    where = np.empty(len(ids), np.int64)
    where[np.searchsorted(ids, index.ids)] = np.arange(len(ids))
    own = np.concatenate([model.votes(at[s : s + AT_ONCE + 1] - at[s], term[at[s] : at[min(s + AT_ONCE, len(ids))]], count[at[s] : at[min(s + AT_ONCE, len(ids))]], where[s : s + AT_ONCE])[0] for s in range(0, len(ids), AT_ONCE)])
    model.curve = logistic(own, y[vector].astype(float))
    return model


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """docs(doc_id, text): doc_id, score, evidence (ids of the nearest examples)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    give_back()

    def run(batches):
        for part in text_slices(batches):
            scores, ids = shared.value.score(part.column("text"))
            near = [[str(i) for i in x[:evidence]] for x in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(scores), "evidence": pa.array(near, pa.list_(pa.string()))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, evidence array<string>")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores under the threshold."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    give_back()

    def run(batches):
        for part in text_slices(batches):
            yield part.filter(pa.array(shared.value.score(part.column("text"))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
