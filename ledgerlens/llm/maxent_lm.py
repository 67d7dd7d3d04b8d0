"""Language-model scores by a hashed maximum-entropy model.

Counts of all training tokens give the base score, exactly: the ``known`` most
frequent tokens go to every task, the others meet their counts in a join.

The model is P(class | history) P(token | class, history). The most frequent
tokens form classes of equal size; all others fall into classes by their last two
letters. Both softmaxes add up weight rows of hashed features of the history: a
bias, the previous token, the previous two, and a skip over the previous one. The
bucket numbers and the tokens with weights of their own (``HEAD``) are fixed.
Within a class of other tokens the probability is (c + 1) / (N + V + 1) by that
class's counts, so the whole is a distribution with one unknown token a class.
Classes start from their counts. Every position of every training text is counted
by (row, outcome). Then ``rounds`` steps of generalised iterative scaling follow,
which need no sample, no order and no learning rate: each compares these counts with
those that the model expects, which are the sums of both softmaxes over every
position of every training text. Before the first step they follow from the counts,
as all rows expect the start; each later step takes a pass over the texts. Counts and
expectations are whole numbers (the latter in units of 1 / ``UNIT``) and summed over
all tasks in a shuffle, so their order makes no difference. Of either the driver sees
one table the size of the weights.

Defined cases: null and empty texts are the end token alone; rows of the same id
and text are one document in both learning and scoring, each row getting its
score; null ids are learned from; without training text counts are zero.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, crc_mod, keyed, materialize, mix, powers, ship, sorted_groups, table, text_slices, words_of

END = "\n"  # no word has white space
AT_ONCE = 1_200_000
KNOWN, HEAD_CLASSES, CLASS_SIZE, TAIL_CLASSES = 300_000, 32, 32, 32
CLASSES, HEAD = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * CLASS_SIZE
BUCKETS, INNER_BUCKETS = 1 << 14, 1 << 11
BATCH, BLOCK = 2048, 1 << 17
ACTIVE, PRIOR = 3, 20.0  # features but for the bias
ROUNDS, UNIT, STEP = 2, 1 << 16, 1 << 14
LANE = ((1 << 32) - 1) // (UNIT + 1)
CELLS, TINY = 1 << 22, 1e-30
BASE, HASHED = 0x9E3779B97F4A7C15, 1 << 18
KEY = "__key"


def coded_with_ends(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts and the end token; which of them each token is, each
    text followed by the end token; offsets."""
    flat, offsets = words_of(part.column("text"), lower=True)
    coded = flat.dictionary_encode()
    offsets = offsets + np.arange(part.num_rows + 1)
    codes = np.empty(offsets[-1], np.int64)
    word = np.ones(len(codes), bool)
    word[offsets[1:] - 1] = False
    codes[word] = coded.indices.to_numpy()
    codes[offsets[1:] - 1] = len(coded.dictionary)
    return pa.concat_arrays([coded.dictionary, pa.array([END], flat.type)]), codes, offsets


def with_ends(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts, each text followed by the end token; offsets."""
    each, codes, offsets = coded_with_ends(part)
    return each.take(pa.array(codes)), offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its bytes modulo 2**64 in an odd base,
    from one running sum over many words, mixed; words beyond ``HASHED`` bytes go one by
    one. Words of one hash would share weights; counts and places in the vocabulary never
    come from a hash alone."""
    words = words.cast(pa.large_string())
    out = np.empty(len(words), U64)
    if not len(words):
        return out
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    most = min(HASHED, int(ends[-1] - ends[0]))
    up, down = powers(BASE, most), powers(pow(BASE, -1, 1 << 64), most + 1)
    sums = np.zeros(most + 1, U64)
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HASHED, side="right")) - 1)
        text = np.frombuffer(data, np.uint8)[ends[start] : ends[stop]]
        if len(text) > HASHED:
            out[start] = xxhash.xxh3_64_intdigest(text)
        else:
            at = ends[start : stop + 1] - ends[start]
            np.cumsum((text + U64(1)) * up[: len(text)], out=sums[1 : len(text) + 1])
            out[start:stop] = mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]])
        start = stop
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts, counted in the task before the shuffle."""

    def summed(tables):
        out = pa.concat_tables(tables).group_by("token").aggregate([("c", "sum")])
        return pa.table([out["token"], out["c_sum"]], ["token", "c"]).combine_chunks()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in text_slices([batch]):
                each, codes, _ = coded_with_ends(part)
                held.append(pa.table([each.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(each)))], ["token", "c"]))
                rows += held[-1].num_rows
                if rows > AT_ONCE:
                    held = [summed(held)]
                    rows = held[0].num_rows
                    if rows > AT_ONCE // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed(held).to_batches()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def tail_class(tokens: pa.Array | list[str]) -> np.ndarray:
    ends = pc.utf8_slice_codeunits(tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.large_string()), -2).dictionary_encode()
    each = ends.dictionary.to_pylist()
    return np.fromiter((zlib.crc32(t.encode()) % TAIL_CLASSES + HEAD_CLASSES for t in each), np.int64, len(each))[ends.indices.to_numpy()]


class Vocabulary:
    """The most frequent tokens with their counts; totals of all and by class."""

    def __init__(self, tokens: list[str], counts: list[int], total: int, distinct: int, tail_n: np.ndarray, tail_v: np.ndarray) -> None:
        self.tokens, self.counts = pa.array(tokens, pa.large_string()), np.array([*counts, 0], np.int64)
        self.total, self.distinct, self.tail_n, self.tail_v = total, distinct, tail_n, tail_v
        self.kind = np.arange(len(tokens)) // CLASS_SIZE
        self.kind[HEAD:] = tail_class(tokens[HEAD:])
        hashes = word_hashes(self.tokens)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], ~U64(0))
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << 18, dtype=U64) << U64(46))

    def look_up(self, flat: pa.Array) -> tuple[np.ndarray, ...]:
        """By token: place in the vocabulary (-1 if not there), class, hash."""
        coded = flat.dictionary_encode()
        return self.look_up_coded(coded.dictionary, coded.indices.to_numpy())

    def look_up_coded(self, each: pa.Array, i: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for distinct words ``each`` and which of them every token is."""
        h = word_hashes(each)
        place, kind = np.full(len(h), -1), np.empty(len(h), np.int64)
        if len(self.order):
            near = self.first[h >> U64(46)]  # of the same highest bits, then the first hash that isn't less
            less = np.flatnonzero(self.hashes[near] < h)
            while len(less):
                near[less] += 1
                less = less[self.hashes[near[less]] < h[less]]
            near = self.order[np.minimum(near, len(self.order) - 1)]
            same = pc.equal(self.tokens.take(pa.array(near)), each.cast(self.tokens.type)).to_numpy(zero_copy_only=False)
            place[same] = near[same]
        found = place >= 0
        kind[found] = self.kind[place[found]]
        rest = np.flatnonzero(~found)
        kind[rest] = tail_class(each.take(pa.array(rest)))
        return place[i], kind[i], h[i]


class Softmax:
    """Shares by the sum of a bias row and ``ACTIVE`` rows of features. They are in
    proportion to products of exponentials, which are taken once a row of the weights,
    its greatest weight as 0, and not at every position; the first of the features has
    the bias in it. Products that come near the least of their type go by logarithms."""

    def __init__(self, w: np.ndarray, biases: int) -> None:
        self.logs = w - w.max(1, keepdims=True)
        self.factors = np.exp(self.logs)
        self.first = (self.factors.reshape(-1, biases, w.shape[1]) * self.factors[:biases]).reshape(w.shape)
        self.space = np.empty((2, BATCH, w.shape[1]), w.dtype)

    def products(self, at: np.ndarray) -> np.ndarray:
        """For ``BATCH`` positions at most, until the next call."""
        out, other = self.space[:, : len(at)]
        self.first.take(at[:, 1], 0, out=out, mode="clip")
        for j in range(2, at.shape[1]):
            out *= self.factors.take(at[:, j], 0, out=other, mode="clip")
        return out

    def shares(self, at: np.ndarray, unit: float = 1.0) -> np.ndarray:
        out = self.products(at)
        total = np.einsum("ij->i", out)
        low = np.flatnonzero(total < TINY)
        if len(low):
            out[low], total[low] = np.exp(log_softmax(gathered(self.logs, at[low]))), 1
        out *= (unit / total)[:, None]
        return out

    def log_share(self, at: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Logarithm of the share of one column a row."""
        out = self.products(at)
        own, total = out[np.arange(len(at)), gold], np.einsum("ij->i", out)
        low = np.flatnonzero(own < TINY)
        own[low] = total[low] = 1
        own = np.log(own / total)
        if len(low):
            own[low] = log_softmax(gathered(self.logs, at[low]))[np.arange(len(low)), gold[low]]
        return own


class Weights:
    def __init__(self, outer: np.ndarray, inner: np.ndarray) -> None:
        self.outer, self.inner = outer, inner  # (BUCKETS, CLASSES), (INNER_BUCKETS * HEAD_CLASSES, CLASS_SIZE)

    def softmaxes(self) -> tuple[Softmax, Softmax]:
        """Of both tables; made once a process, where they are first used."""
        if not hasattr(self, "_softmaxes"):
            self._softmaxes = Softmax(self.outer, 1), Softmax(self.inner, HEAD_CLASSES)
        return self._softmaxes

    def __getstate__(self) -> dict:
        return {"outer": self.outer, "inner": self.inner}

    @classmethod
    def initial(cls, v: Vocabulary) -> Weights:
        head = np.zeros(HEAD)
        head[: min(HEAD, len(v.tokens))] = v.counts[:-1][:HEAD]
        by_class = np.concatenate([head.reshape(HEAD_CLASSES, -1).sum(1), v.tail_n + v.tail_v + 1.0])
        outer, inner = np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((INNER_BUCKETS, HEAD_CLASSES, CLASS_SIZE), np.float32)
        outer[0] = np.log(np.maximum(by_class, 1e-3) / by_class.sum())
        inner[0] = np.log(np.maximum(head, 1e-3)).reshape(HEAD_CLASSES, CLASS_SIZE)
        return cls(outer, inner.reshape(-1, CLASS_SIZE))


def features(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each position's history for both softmaxes; 0 is the bias."""
    start = np.zeros(len(h), bool)
    start[offsets[:-1]] = True
    one = np.concatenate([np.zeros(1, U64), h[:-1]])
    one[start] = 1
    two = np.concatenate([np.zeros(1, U64), one[:-1]])
    two[start] = 2
    names = [mix(x) >> U64(32) for x in (one ^ U64(11), one * U64(3) + two, two ^ U64(13))]
    return tuple(np.stack([np.zeros(len(h), np.int64), *(((x * U64(size - 1) >> U64(32)) + U64(1)).view(np.int64) for x in names)]).T for size in (BUCKETS, INNER_BUCKETS))


def log_softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(1, keepdims=True)
    return a - np.log(np.exp(a).sum(1, keepdims=True))


def gathered(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = w.take(at[:, 0], 0)
    for j in range(1, at.shape[1]):
        out += w.take(at[:, j], 0)
    return out


def log_probability(w: Weights, v: Vocabulary, place: np.ndarray, kind: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Natural logarithm by token; for tokens out of the vocabulary without the
    count, which is added later."""
    out = np.empty(len(place))
    by_class, by_token = w.softmaxes()
    for s in range(0, len(place), BATCH):
        at = slice(s, s + BATCH)
        c = kind[at]
        out[at] = by_class.log_share(outer[at], c)
        head = np.flatnonzero(c < HEAD_CLASSES)
        rows = inner[at][head] * HEAD_CLASSES + c[head, None]
        out[s + head] += by_token.log_share(rows, place[at][head] % CLASS_SIZE)
    tail = np.flatnonzero(kind >= HEAD_CLASSES)
    t = kind[tail] - HEAD_CLASSES
    out[tail] -= np.log(v.tail_n[t] + v.tail_v[t] + 1.0)
    out[tail] += np.where(place[tail] >= 0, np.log(v.counts[place[tail]] + 1.0), 0.0)
    return out


def scaled(w: np.ndarray, seen: np.ndarray, expected: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A step of generalised iterative scaling on whole counts: each weight moves by
    the logarithm of seen over expected count, shared among the ``ACTIVE`` features
    that move. ``PRIOR`` further observations a row, seen as at the ``start`` and
    expected as the row's others, hold back rare rows. An expectation too small for
    ``UNIT`` counts as at the start, half a unit a position at most."""
    expected = np.where(expected > 0, expected, seen.sum(1, keepdims=True) * np.minimum(start, 0.5 / UNIT))
    more = (expected + start) * (PRIOR / (seen.sum(1, keepdims=True) + 1))
    return (w + np.log((seen + PRIOR * start) / (expected + more)) / ACTIVE).astype(np.float32)


def seen_cells(v: Vocabulary, part: pa.RecordBatch) -> np.ndarray:
    """Cells of the outer, then of the inner weights: one for each feature of each
    position of the texts. The bias has none: it starts where its counts are."""
    *coded, offsets = coded_with_ends(part)
    place, kind, h = v.look_up_coded(*coded)
    outer, inner = features(h, offsets)
    head = np.flatnonzero(kind < HEAD_CLASSES)
    rows = inner[head, 1:] * HEAD_CLASSES + kind[head, None]
    return np.concatenate([(outer[:, 1:] * CLASSES + kind[:, None]).ravel(), (rows * CLASS_SIZE + (place[head] % CLASS_SIZE)[:, None]).ravel() + BUCKETS * CLASSES])


class Seen:
    """Counts by cell over slices of texts."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.total = v, np.zeros(BUCKETS * CLASSES + INNER_BUCKETS * HEAD, np.int64)
        self.held, self.cells = [], 0

    def add(self, part: pa.RecordBatch) -> None:
        self.held.append(seen_cells(self.v, part).astype(np.int32))
        self.cells += len(self.held[-1])
        if self.cells >= CELLS:
            self._flush()

    def _flush(self) -> None:
        self.total += np.bincount(np.concatenate([np.empty(0, np.int32), *self.held]), minlength=len(self.total))
        self.held, self.cells = [], 0

    def done(self) -> np.ndarray:
        self._flush()
        return self.total


class Expected:
    """Sums by cell, over slices of texts, of the softmaxes of each position's history,
    in units of 1 / UNIT. Two sums of 32 bits share a number while they can, that is, as
    long as no row of the weights has met more than ``LANE`` positions. Shares are
    rounded up or down in turn, by history and place in the text, so that small ones are
    right on average and not lost."""

    def __init__(self, v: Vocabulary, w: Weights) -> None:
        self.v, self.softmaxes = v, w.softmaxes()
        self.held = [np.zeros(x.size // 2, U64) for x in (w.outer, w.inner)]
        self.met = [np.zeros(len(x), np.int64) for x in (w.outer, w.inner)]
        self.totals = [np.zeros(x.size, np.int64) for x in (w.outer, w.inner)]
        turns = np.random.default_rng(1).permuted(np.tile((np.arange(1024, dtype=np.float32) / 1024)[:, None], CLASSES), axis=0)
        self.turns = turns, turns[:, :CLASS_SIZE].copy()

    def add(self, part: pa.RecordBatch) -> None:
        *coded, offsets = coded_with_ends(part)
        _, kind, h = self.v.look_up_coded(*coded)
        outer, inner = features(h, offsets)
        turn = (np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets)) + outer[:, 2]) % len(self.turns)
        for s in range(0, len(kind), STEP):
            c = kind[s : s + STEP]
            head = np.flatnonzero(c < HEAD_CLASSES)
            self._add(0, outer[s : s + STEP], turn[s : s + STEP])
            self._add(1, inner[s : s + STEP][head] * HEAD_CLASSES + c[head, None], turn[s : s + STEP][head])

    def _add(self, which: int, rows: np.ndarray, turn: np.ndarray) -> None:
        met = np.bincount(rows[:, 1:].ravel(), minlength=len(self.met[which]))
        if (self.met[which] + met).max() > LANE:
            self._flush(which)
        self.met[which] += met
        soft, turns = self.softmaxes[which], self.turns[which]
        width = turns.shape[1]
        lane = np.arange(width // 2)
        extra, share, cells = np.empty((BATCH, width), np.float32), np.empty((BATCH, width), np.int32), np.empty((BATCH, width // 2), np.int64)
        for s in range(0, len(rows), BATCH):
            at = rows[s : s + BATCH]
            n = len(at)
            a = soft.shares(at, UNIT)
            a += turns.take(turn[s : s + BATCH], 0, out=extra[:n], mode="clip")
            share[:n] = a  # cut off to whole numbers
            pairs = share[:n].view(U64).ravel()
            for j in range(1, ACTIVE + 1):
                np.add((at[:, j] * len(lane))[:, None], lane, out=cells[:n])
                np.add.at(self.held[which], cells[:n].ravel(), pairs)

    def _flush(self, which: int) -> None:
        self.totals[which] += self.held[which].view(np.uint32)
        self.held[which][:] = 0
        self.met[which][:] = 0

    def done(self) -> np.ndarray:
        for which in (0, 1):
            self._flush(which)
        return np.concatenate(self.totals)


def summed(docs: DataFrame, begin) -> np.ndarray:
    """Sums by cell over all texts; ``begin()`` makes the ``Seen`` or ``Expected`` of a
    task. How rows are dealt makes no difference."""

    def count(batches):
        sums = None
        for batch in batches:
            for part in text_slices([batch]):
                sums = sums or begin()
                sums.add(part)
        total = sums.done() if sums else np.empty(0, np.int64)
        for block in range(0, len(total), BLOCK):
            n = total[block : block + BLOCK]
            if n.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block // BLOCK], pa.int32()), "n": pa.array([n.tobytes()], pa.binary())})

    def add(batches):
        for group in sorted_groups(batches, ["block"]):
            total = {}
            for b, n in zip(group.column("block").to_pylist(), group.column("n").to_pylist()):
                total[b] = total.get(b, 0) + np.frombuffer(n, np.int64)
            for b, n in total.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "n": pa.array([n.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "block int, n binary")
    out = np.zeros(BUCKETS * CLASSES + INNER_BUCKETS * HEAD)
    for row in counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, n binary").collect():
        n = np.frombuffer(row["n"], np.int64)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(n)] = n
    return out


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """docs(text) of training. Every position of every text counts once, and its
    softmaxes once a round."""
    sc = docs.sparkSession.sparkContext
    w = Weights.initial(v)
    shared_v = sc.broadcast(v)
    split = lambda x: (x[: w.outer.size].reshape(w.outer.shape), x[w.outer.size :].reshape(w.inner.shape))
    seen = split(summed(docs, lambda: Seen(shared_v.value)))
    # at the start only the bias has weights, so all rows of a softmax expect its distribution
    start = (np.exp(log_softmax(w.outer[:1].astype(float))), np.tile(np.exp(log_softmax(w.inner[:HEAD_CLASSES].astype(float))), (INNER_BUCKETS, 1)))
    expected = [n.sum(1, keepdims=True) * p for n, p in zip(seen, start)]
    for left in reversed(range(rounds)):
        w = Weights(*map(scaled, (w.outer, w.inner), seen, expected, start))
        if left:
            shared_w = sc.broadcast(w)
            expected = split(summed(docs, lambda at=shared_w: Expected(shared_v.value, at.value)) / UNIT)
            shared_w.destroy()
    return w


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(known).toArrow().to_pydict()
    order = sorted(range(len(top["token"])), key=lambda i: (-top["c"][i], top["token"][i]))
    if END in top["token"]:  # the end token is always in a class of its own kind
        e = top["token"].index(END)
        order = [e, *(i for i in order if i != e)]
    tokens, c = [top["token"][i] for i in order], [top["c"][i] for i in order]
    kind = F.crc32(F.substring("token", -2, 2).cast("binary")) % TAIL_CLASSES
    n, v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in counts.groupBy(kind.alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r["t"]], v[r["t"]] = r["n"], r["v"]
    head = tail_class(tokens[:HEAD]) - HEAD_CLASSES
    n -= np.bincount(head, c[:HEAD], TAIL_CLASSES)
    v -= np.bincount(head, minlength=TAIL_CLASSES)
    return Vocabulary(tokens, c, total["n"], total["v"], n, v)


def score(docs: DataFrame, held_out, known: int = KNOWN) -> DataFrame:
    """docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; learns from rows that aren't ``held_out``."""
    docs = docs.select("doc_id", "text")
    ship(docs.sparkSession)
    base, plain = keyed(docs, KEY)
    each = base if plain else base.dropDuplicates([KEY])
    counts = materialize(count_tokens(each.where(~held_out)))
    v = vocabulary(counts, known)
    w = train(each.where(~held_out), v)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((v, w))

    def run(batches):
        voc, weights = shared.value
        log_counts = np.log10(voc.counts + 1.0)
        for batch in batches:
            for part in text_slices([batch]):
                each_word, codes, offsets = coded_with_ends(part)
                place, kind, h = voc.look_up_coded(each_word, codes)
                outer, inner = features(h, offsets)
                model = np.concatenate([np.zeros(1), np.cumsum(log_probability(weights, voc, place, kind, outer, inner))]) / np.log(10)
                simple = np.concatenate([np.zeros(1), np.cumsum(np.where(place >= 0, log_counts[place], 0.0))])
                seen = np.concatenate([[0], np.cumsum(place >= 0)])
                n = np.diff(offsets)
                at = lambda x: x[offsets[1:]] - x[offsets[:-1]]
                key = part.column(KEY)
                own = pa.array(np.zeros(part.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([key, pa.nulls(part.num_rows, pa.string()), own, pa.array(n), pa.array(at(seen)), pa.array(at(simple)), pa.array(at(model))], NAMES)
                rest = np.flatnonzero(place < 0)
                if len(rest):
                    row = np.repeat(np.arange(len(n)), n)[rest]
                    size = len(each_word)
                    pair, times = np.unique(row * size + codes[rest], return_counts=True)
                    zero = pa.array(np.zeros(len(pair), np.int64))
                    nil = pa.array(np.zeros(len(pair)))
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(pair // size)), each_word.take(pa.array(pair % size)).cast(pa.string()), pa.array(times.astype(np.int64)), zero, zero, nil, nil], NAMES)

    rows = materialize(each.select(KEY, "text").mapInArrow(run, f"{KEY} long, token string, times long, n long, seen long, simple double, model double"))
    lg = F.col("times") * F.log10(F.col("c") + 1.0)
    tail = rows.where("token IS NOT NULL").select(KEY, "token", "times").join(counts, "token").groupBy(KEY).agg(F.sum("times").alias("more"), F.sum(lg).alias("lg"))
    scored = rows.where("token IS NULL").select(KEY, "n", "seen", "simple", "model").join(tail, KEY, "left")
    more = F.coalesce("lg", F.lit(0.0))
    denominator = float(np.log10(v.total + v.distinct + 1.0))
    scored = scored.select(
        F.col(KEY).alias("__k"), F.col("n").alias("n_tokens"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"), (F.col("simple") + more - F.col("n") * denominator).alias("base_score"), (F.col("model") + more).alias("score"),
    )
    return base.select("doc_id", held_out.alias("held_out"), KEY).join(scored, F.col(KEY) == F.col("__k")).drop(KEY, "__k")


NAMES = [KEY, "token", "times", "n", "seen", "simple", "model"]


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
