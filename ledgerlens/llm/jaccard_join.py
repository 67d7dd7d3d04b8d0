"""Exact n-gram Jaccard join and its connected components, by signature trees.

Documents are sets of hashed word shingles; two link if their Jaccard similarity
is at least ``num / den``.

1. Equal sets are one set, that of the smallest document.
2. Every set is dealt by hash to so many buckets that two sets that link have an
   equal one (see ``bucket_keys``: this holds for all of them, not most).
   Documents with an equal bucket form a block; sorted by size, neighbours whose
   sizes could link are chained. The chains' connected components are candidate
   families: linked documents are always in one family. Chains, not pairs, so a
   block of any size costs its length; tasks chain what they see before the
   shuffle. A bucket holds three shingles or more (two at low thresholds), so passages that many documents
   share rarely tie them together.
3. A family is dealt to leaves of about ``LEAF`` shingles, like sizes and like
   smallest hashes together; a leaf is a task, however large its family. Each leaf
   gets a signature tree: documents with similar signatures side by side, nodes with
   the OR of their token bitmaps and their range of sizes. A dual traversal drops
   node pairs whose largest possible overlap is too small, or that are one component
   already, and compares the sets of surviving pairs exactly.
4. Families of several leaves go on with one document of each component found so
   far, dealt to new leaves, while that at least halves them. Of what is then still
   apart, every leaf of the documents outside the family's largest component meets
   every leaf of the family whose sizes could link, as a task of its own, which
   leaves out pairs of one component. So no pair that could link is left out, and a
   group of near copies of any size costs its length.

Nothing is collected; components are found with joins. Shingles are told apart by
64-bit hashes, which are not checked against the words.

Defined cases: null texts and texts without words have no shingles and link with
nothing; texts shorter than the shingle are one shingle, their whole word
sequence; rows of the same id and text are one document, null ids come last (see
``keyed``), and a component of theirs is named by its first document's id; extra
columns, whatever their names, are kept by ``keep_first`` and else left out; long
texts are read whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, discard, give_back, keyed, materialize, mix, plain_names, ship, sorted_groups, starts_inside, table, text_slices, window_hashes, word_hashes, words_of
from .substring_dedup import Pool, signed

#: Shingles of a leaf, on average.
LEAF = 1 << 18
ROWS_AT_ONCE = 600_000
#: Keys that a task compares, on average: 40 MB of them.
TASK_ROWS = 2_000_000
#: Children of a node, bits of a bitmap for each shingle, and node pairs at once.
FAN, SPREAD, AT_ONCE = 4, 64, 20_000
KEY = "__key"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each; and offsets."""
    flat, offsets = words_of(texts, lower=True)
    h = word_hashes(flat)
    sizes = np.diff(offsets)
    where, row, _ = starts_inside(offsets, k)
    grams = window_hashes(h, k)[where]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = np.array([mix(window_hashes(h[offsets[r] : offsets[r + 1]], int(sizes[r])) ^ U64(sizes[r]))[0] for r in short], U64)
        grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(sizes) + 1))


def size_classes(num: int, den: int) -> np.ndarray:
    """Exclusive upper ends of classes of sizes, such that sets that can link are
    of the same class or of neighbours."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


@lru_cache
def bucket_plan(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By size class: its exclusive end, how many buckets, and how many shingles
    a bucket must hold to be used. As many buckets as let nearly every set have
    more usable ones than two linked sets can differ in."""
    ends = size_classes(num, den)
    buckets, least = np.ones(len(ends), np.int64), np.ones(len(ends), np.int64)
    for i, top in enumerate(ends - 1):
        differ = 2 * (den - num) * int(top) // (den + num)
        best = None
        for need in (3, 2, 1) if top > 24 else (2, 1):
            for m in sorted({differ + 1 + math.ceil(differ * x / 20) for x in range(25)} | {differ + 1, differ + 2}):
                rate = top / m
                poor = sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(need))
                margin = m * (1 - poor) - differ - 1 - 3 * math.sqrt(m * poor * (1 - poor))
                if best is None or margin > best[0]:
                    best = margin, m, need
                if margin >= 0:
                    break
            if best[0] >= 0:
                break
        buckets[i], least[i] = best[1:]
    return ends, buckets, least


def bucket_keys(grams: np.ndarray, at: np.ndarray, num: int, den: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set such that sets that link share one; (row, key).

    Under the class of the larger, a set of n and any set that it links with
    differ in at most d = (den - num) (n + the other's size) / (den + num) shingles.
    Shingles are dealt to buckets by hash. If a set has more than d usable
    buckets (of enough shingles), one of them is the same in the other set, so
    the hash of what it holds, each set being keyed under its own class and the
    next, is a shared key. A set that lacks usable buckets is dealt again by other
    hashes, up to ``rounds`` times, and is at last keyed by its prefix, the
    n - ceil(t n) + 1 smallest hashes. Of two linked sets either one is not lacking in
    a round that both enter, or both come to the prefixes, which then share one.
    """
    ends, buckets, least = bucket_plan(num, den)
    n = np.diff(at)
    own = np.searchsorted(ends, n, side="right")
    rows, keys = [], []
    for step in (0, 1):
        row = np.repeat(np.arange(len(n)), n)
        part = grams
        differ = (den - num) * (n + np.minimum(n * den // num, ends[own + step] - 1)) // (den + num)
        enter = differ > 0  # else only equal sets link
        for turn in range(rounds + 1):
            if not enter.any():
                break
            keep = enter[row]
            row, part = row[keep], part[keep]
            label = (own + step)[row]
            if turn == rounds:
                local = np.arange(len(row)) - np.searchsorted(row, row)
                use = local < (n + (-num * n // den) + 1)[row]
                rows.append(row[use])
                keys.append(mix(part[use] ^ U64(0x9FB21C651E98DF25) ^ label[use].astype(U64)))
                break
            deal = mix(part ^ U64(0xD1B54A32D192ED03 + turn))
            b = ((deal >> U64(32)) * buckets[label].astype(U64)) >> U64(32)
            place = (row.astype(U64) << U64(32)) | b
            order = np.argsort(place, kind="stable")
            place, deal = place[order], deal[order]
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            size = np.diff(np.concatenate([head, [len(place)]]))
            total = np.add.reduceat(mix(deal), head)
            r = (place[head] >> U64(32)).astype(np.int64)
            good = size >= least[(own + step)[r]]
            r, total, bucket = r[good], total[good], place[head][good] & U64(0xFFFFFFFF)
            name = ((own + step)[r].astype(U64) << U64(40)) + (U64(turn) << U64(36)) + bucket
            rows.append(r)
            keys.append(mix(total + mix(name ^ U64(0x13198A2E03707344))))
            enter = enter & (np.bincount(r, minlength=len(n)) <= differ)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, U64)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def records(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs(__key, doc_id, text): __key, doc_id, n, f1, f2, grade (class of the
    size), low (of the smallest hash) and keys."""
    ends = size_classes(num, den)

    def run(batches):
        for batch in batches:
            for part in text_slices([batch]):
                grams, at = shingle_sets(part.column("text"), k)
                n = np.diff(at)
                rows, keys = bucket_keys(grams, at, num, den)
                sums = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(salt)), dtype=U64)])
                    sums.append(pa.array(signed(total[at[1:]] - total[at[:-1]])))
                lists = pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(len(n) + 1)).astype(np.int32), pa.array(signed(keys)))
                low = np.zeros(len(n), U64)
                low[n > 0] = mix(grams[at[:-1][n > 0]])
                marks = [pa.array(np.searchsorted(ends, n, side="right").astype(np.int32)), pa.array(signed(low))]
                yield pa.RecordBatch.from_arrays([part.column(KEY), part.column("doc_id"), pa.array(n.astype(np.int32)), *sums, *marks, lists], [KEY, "doc_id", "n", "f1", "f2", "grade", "low", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(KEY, "doc_id", "text").mapInArrow(run, f"{KEY} long, doc_id {kind}, n int, f1 long, f2 long, grade int, low long, keys array<long>")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the edges with the smallest that it hangs together with."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _chains(t, lo, hi, key, num, den):
    """Edges along blocks, and each chain as one row. Rows are size ranges."""
    order = np.lexsort((key, lo, t))
    t, lo, hi, key = t[order], lo[order].astype(np.int64), hi[order].astype(np.int64), key[order]
    new = np.ones(len(t), bool)
    block = np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else t
    reach = np.maximum.accumulate(hi + block * (1 << 40)) - block * (1 << 40) if len(t) else hi
    new[1:] = (block[1:] != block[:-1]) | (lo[1:] * num > reach[:-1] * den)
    head = np.flatnonzero(new)
    chain = np.cumsum(new) - 1
    rest = ~new
    ends = np.concatenate([head[1:], [len(t)]]) - 1 if len(t) else head
    return (key[head][chain[rest]], key[rest]), (t[head], lo[head], reach[ends], key[head])


def families(keyed_sets: DataFrame, num: int, den: int) -> DataFrame:
    """keyed_sets(__key, n, keys): edges (a, b) that hold each family together."""

    def rows(t, lo, hi, k, b):
        return pa.RecordBatch.from_arrays([pa.array(signed(t)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(k), pa.array(b)], ["t", "lo", "hi", "k", "b"])

    def settled(pool):
        t, n, key = pool.take()
        (a, b), (t, lo, hi, k) = _chains(t.view(U64), n, n, key, num, den)
        yield rows(t, lo, hi, k, np.full(len(t), -1))
        if len(a):
            names, root = stars(a, b)
            a, b = root[names != root], names[names != root]
            yield rows(mix(b.view(U64)), np.full(len(a), -1), np.full(len(a), -1), a, b)

    def emit(batches):
        pool = Pool(ROWS_AT_ONCE)
        for batch in batches:
            lists = batch.column("keys")
            sizes = np.diff(lists.offsets.to_numpy())
            key, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in (KEY, "n"))
            if pool.add(lists.flatten().to_numpy(), n, key):
                yield from settled(pool)
        if pool.rows:
            yield from settled(pool)

    def meet(batches):
        pool = Pool(ROWS_AT_ONCE)

        def joined():
            names, root = stars(*pool.take())
            return pa.RecordBatch.from_arrays([pa.array(root[names != root]), pa.array(names[names != root])], ["a", "b"])

        for group in sorted_groups(batches, ["t"]):
            t, lo, hi, k, b = (group.column(c).to_numpy() for c in ("t", "lo", "hi", "k", "b"))
            edge = lo < 0
            (x, y), _ = _chains(t[~edge].view(U64), lo[~edge], hi[~edge], k[~edge], num, den)
            x, y = np.concatenate([x, k[edge]]), np.concatenate([y, b[edge]])
            if len(x) and pool.add(x, y):
                yield joined()
        if pool.rows:
            yield joined()

    out = keyed_sets.select(KEY, "n", "keys").mapInArrow(emit, "t long, lo int, hi int, k long, b long")
    # a document is named once by each task that has links of it, so tasks are as large
    # as the data gives, whatever the number of partitions is set to; they stream what
    # Spark has sorted, and need no more memory for that
    rows = keyed_sets.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    tasks = max(1, round(rows / TASK_ROWS))
    return out.repartition(tasks, "t").sortWithinPartitions("t").mapInArrow(meet, "a long, b long").distinct()


def _labels(edges: DataFrame) -> DataFrame:
    """edges(x, y): (v, root) for every end. Labels fall to the smallest
    neighbour's, then to their label's label, until none changes; every round is a
    table of its own, and the one before goes."""
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = materialize(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        old = labels.select("v", "root")
        near = both.join(old.withColumnRenamed("v", "y"), "y").groupBy(F.col("x").alias("v")).agg(F.min("root").alias("m"))
        new = old.join(near, "v").select("v", F.least("root", "m").alias("low"), F.col("root").alias("old"))
        # a label's own label is at most as large: two hops in one round
        up = new.select(F.col("v").alias("low"), F.col("low").alias("higher"))
        new = materialize(new.join(up, "low", "left").select("v", F.least("low", "higher").alias("root"), "old"))
        discard(labels)
        if not new.where("root <> old").limit(1).count():
            discard(both)
            return new.select("v", "root")
        labels = new


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), a table, a < b: (v, root) for every end, root being the smallest
    reachable. Each b hangs on the smallest a it was seen with; what remains is a
    small graph between those a, where labels travel."""
    edges = edges.where("a <> b").distinct()
    low = materialize(edges.groupBy("b").agg(F.min("a").alias("m")))
    heads = edges.select("a").distinct()
    across = edges.join(low, "b").where("m <> a").select(F.col("m").alias("x"), F.col("a").alias("y"))
    inner = low.join(heads, low["b"] == heads["a"], "left_semi").select(F.col("m").alias("x"), F.col("b").alias("y"))
    labels = _labels(across.union(inner))
    hung = low.select(F.col("b").alias("v"), F.col("m").alias("at"))
    tops = heads.join(low.select("b"), heads["a"] == low["b"], "left_anti").select(F.col("a").alias("v"), F.col("a").alias("at"))
    return hung.union(tops).join(labels.withColumnRenamed("v", "at"), "at", "left").select("v", F.coalesce("root", "at").alias("root"))


class SignatureTree:
    """Sets in an order that puts like beside like, under nodes of FAN children.
    ``levels[0]`` are the sets; a node of a higher level has the OR of its
    children's bitmaps, their range of sizes and their largest excess (shingles
    beyond distinct bits). Bitmaps are as wide as sets of this family need, so a
    tree takes memory in proportion to the family's shingles."""

    def __init__(self, tokens: np.ndarray, at: np.ndarray) -> None:
        sizes = np.diff(at)
        n = len(sizes)
        bits = 1 << int(np.clip(np.ceil(np.log2(SPREAD * max(1, sizes.mean()))), 8, 17))
        bitmaps = np.zeros((n, bits // 64), U64)
        for s in range(0, n, 256):  # a few sets at once: no long-lived arrays beside the bitmaps
            e = min(n, s + 256)
            row, bit = np.repeat(np.arange(s, e), sizes[s:e]), mix(tokens[at[s] : at[e]]) % U64(bits)
            np.bitwise_or.at(bitmaps, (row, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
        self.levels = [(bitmaps, sizes, sizes, sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            bitmaps, lo, hi, excess = self.levels[-1]
            heads = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmaps, heads), np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), np.maximum.reduceat(excess, heads)))

    def one_label(self, label: np.ndarray) -> list[np.ndarray]:
        """By level and node: the component of all sets below, -1 if several."""
        out = [label]
        while len(out) < len(self.levels):
            heads = np.arange(0, len(out[-1]), FAN)
            least, most = np.minimum.reduceat(out[-1], heads), np.maximum.reduceat(out[-1], heads)
            out.append(np.where(least == most, least, -1))
        return out

    def near(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold a link, by sizes and then by bitmaps."""
        bitmaps, lo, hi, excess = self.levels[level]
        keep = np.flatnonzero((hi[x] * den >= lo[y] * num) & (hi[y] * den >= lo[x] * num))
        step = max(1, (1 << 20) // bitmaps.shape[1])
        for s in range(0, len(keep), step):
            part = keep[s : s + step]
            both = np.bitwise_count(bitmaps[x[part]] & bitmaps[y[part]]).sum(1, dtype=np.int64)
            few = (both + np.minimum(excess[x[part]], excess[y[part]])) * (num + den) < num * (lo[x[part]] + lo[y[part]])
            part[few] = -1
        return keep[keep >= 0]


def link_family(sets: list[np.ndarray], num: int, den: int, part: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Component (smallest position) of each set, and how many pairs were
    compared. Sets are sorted and not empty. With ``part``, pairs of the same part
    are left out; sets of equal ``known`` are one component from the start."""
    n = len(sets)
    grade = np.searchsorted(size_classes(num, den), [len(x) for x in sets], side="right")
    order = np.lexsort((np.array([x[0] if len(x) else 0 for x in sets], U64), grade))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([sets[i] for i in order]) if n else np.empty(0, U64)
    tree = SignatureTree(flat, at)
    side = None if part is None else np.asarray(part)[order]
    label = np.arange(n)
    if known is not None:
        _, first, own = np.unique(np.asarray(known)[order], return_index=True, return_inverse=True)
        label = first[own]

    def compare(p: np.ndarray, q: int) -> None:
        nonlocal label
        own = flat[at[q] : at[q + 1]]
        begin = np.concatenate([[0], np.cumsum(sizes[p])])
        theirs = flat[np.repeat(at[p] - begin[:-1], sizes[p]) + np.arange(begin[-1])]
        found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(found, begin[:-1], dtype=np.int64)
        for root in np.unique(label[p[common * den >= num * (sizes[p] + sizes[q] - common)]]):
            a, b = sorted((int(root), int(label[q])))
            if a != b:
                members[a] += members[b]
                label[members.pop(b)] = a

    members: dict[int, list[int]] = {}
    for i, name in enumerate(label.tolist()):
        members.setdefault(name, []).append(i)
    compared, zero = 0, np.zeros(1, np.int64)
    stack = [(len(tree.levels) - 1, zero, zero)]
    fan = np.arange(FAN)
    while stack:
        level, x, y = stack.pop()
        of = tree.one_label(label)[level]
        open_ = ~((of[x] == of[y]) & (of[x] >= 0)) if level else label[x] != label[y]
        x, y = x[open_], y[open_]
        near = tree.near(level, x, y, num, den)
        x, y = x[near], y[near]
        if level:
            i = (x[:, None, None] * FAN + fan[:, None] + 0 * fan).ravel()
            j = (y[:, None, None] * FAN + fan + 0 * fan[:, None]).ravel()
            real = (j < len(tree.levels[level - 1][1])) & ((i < j) if level == 1 else (i <= j))
            i, j = i[real], j[real]
            first = np.argsort(i != j, kind="stable")[::-1]  # near the diagonal comes off the stack first
            stack += [(level - 1, i[s], j[s]) for s in np.array_split(first, -(-len(first) // AT_ONCE))] if len(first) else []
            continue
        if side is not None:
            apart = side[x] != side[y]
            x, y = x[apart], y[apart]
        by = np.argsort(y, kind="stable")
        x, y = x[by], y[by]
        cuts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1], [True]])) if len(y) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            p, q = x[s:e], int(y[s])
            for turn in (0, 1):  # first one of each component, then those still apart
                p = p[label[p] != label[q]]
                now = np.unique(label[p], return_index=True)[1] if turn == 0 else np.arange(len(p))
                for some in np.array_split(now, -(-int(sizes[p[now]].sum()) // ROWS_AT_ONCE)) if len(p) else []:
                    compare(p[some], q)
                compared += len(now)
                p = np.delete(p, now)
    out = np.empty(n, np.int64)
    out[order] = label
    smallest = np.full(n, n)
    np.minimum.at(smallest, out, np.arange(n))
    return smallest[out], compared


def leaves(member: DataFrame) -> DataFrame:
    """member(v, root, n, grade, low): with ``leaf``, and whether it is the ``whole``
    family. A family of several leaves is cut by size class, then by the smallest
    hash, then at random where many have the same."""

    def cut(df: DataFrame, by: list[str], name: str) -> DataFrame:
        # a table of those that need cutting alone, which are few: the members stay where they are
        sums = df.groupBy(*by).agg(F.ceil(F.sum(F.col("n").cast("long")) / LEAF).alias(name)).where(f"{name} > 1")
        return df.join(materialize(sums), by, "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long")))

    out = cut(member, ["root"], "size").withColumn("class", F.when(F.col("size") > 1, F.col("grade")).otherwise(-1))
    out = cut(out, ["root", "class"], "cells").withColumn("cell", F.pmod("low", "cells"))
    out = cut(out, ["root", "class", "cell"], "pieces").withColumn("piece", F.pmod(F.xxhash64("v"), "pieces"))
    return out.select(*member.columns, F.xxhash64("root", "class", "cell", "piece").alias("leaf"), (F.col("size") <= 1).alias("whole"))


def compare(docs: DataFrame, placed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs(__key, text), placed(v, leaf, side, label): edges (a, b) between labels
    that documents of one leaf join. With sides, pairs of one side are left out."""

    def run(batches):
        for group in sorted_groups(batches, ["leaf"]):
            leaf, label, key = (group.column(c).to_numpy() for c in ("leaf", "label", KEY))
            side = group.column("side").to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])
            text = group.column("text")
            a, b = [], []
            for s, e in zip(at[:-1], at[1:]):
                if e - s < 2:
                    continue
                sets = []
                for piece in text_slices(pa.table({"text": text.slice(s, e - s)}).to_batches()):
                    grams, offsets = shingle_sets(piece.column("text"), k)
                    sets += [grams[p:q] for p, q in zip(offsets[:-1], offsets[1:])]
                rank = np.lexsort((side[s:e], key[s:e]))
                names = label[s:e][rank]
                sides = side[s:e][rank]
                joined, _ = link_family([sets[r] for r in rank], num, den, sides if sides.any() else None, names)
                # of each component the smallest label, and an edge to every other one
                order = np.lexsort((names, joined))
                joined, names = joined[order], names[order]
                head = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
                low = np.repeat(names[head], np.diff(np.concatenate([head, [len(names)]])))
                a.append(low[low != names])
                b.append(names[low != names])
            if a and len(got := np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
            del group, text
            give_back()

    with_text = docs.select(KEY, "text").hint("merge").join(placed, docs[KEY] == placed["v"]).select("leaf", "side", "label", KEY, "text")
    return with_text.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, member: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs(__key, text), member(v, root, n, grade, low) of families: (v, label) of
    every member, label being the smallest of its true component."""
    # the texts of families, a part of all, once; one kind of join at every size
    docs = materialize(docs.select(KEY, "text").hint("merge").join(member.select("v"), F.col(KEY) == F.col("v"), "left_semi"))
    level = materialize(leaves(member))
    one = F.lit(0).cast("byte").alias("side")
    placed = level.select("v", "leaf", one, F.col("v").alias("label"))
    found = materialize(compare(docs, placed, k, num, den))
    known = materialize(_relabelled(level.withColumn("label", F.col("v")), found))
    done, open_ = known.where("whole"), known.where("NOT whole")
    if not open_.limit(1).count():
        return done.select("v", "label")
    # rounds: one document of each component
    left = open_.select("label").distinct().count()
    while True:
        reps = materialize(leaves(open_.where("v = label").select(*member.columns)))
        found = materialize(compare(docs, reps.select("v", "leaf", one, F.col("v").alias("label")), k, num, den))
        open_ = materialize(_relabelled(open_, found))
        was, left = left, open_.select("label").distinct().count()
        if not left or 2 * left > was:
            break
    # what lies outside the largest component of its family meets all of the family
    sums = open_.groupBy("root", "label").agg(F.sum(F.col("n").cast("long")).alias("n"))
    most = sums.groupBy("root").agg(F.max_by("label", "n").alias("most"))
    rest = open_.join(most, "root").where("label <> most").select(*member.columns, "label")
    near = materialize(leaves(rest))
    range_of = lambda df, x: df.groupBy("root", F.col("leaf").alias(f"{x}_leaf")).agg(F.min("grade").alias(f"{x}_lo"), F.max("grade").alias(f"{x}_hi"))
    pairs = range_of(near, "x").join(range_of(open_, "y"), "root").where("x_lo <= y_hi + 1 AND y_lo <= x_hi + 1").select("x_leaf", "y_leaf", F.xxhash64("x_leaf", "y_leaf").alias("pair"))
    pairs = materialize(pairs)
    sides = [df.join(pairs, F.col("leaf") == F.col(f"{x}_leaf")).select("v", F.col("pair").alias("leaf"), F.lit(i).cast("byte").alias("side"), "label") for i, (df, x) in enumerate(((near, "x"), (open_, "y")))]
    found = materialize(compare(docs, sides[0].union(sides[1]), k, num, den))
    return done.select("v", "label").union(_relabelled(open_, found).select("v", "label"))


def _relabelled(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known with the labels that edges between labels make of its labels."""
    roots = components(edges).select(F.col("v").alias("label"), F.col("root").alias("new"))
    return known.join(roots, "label", "left").withColumn("label", F.coalesce("new", "label")).select(*known.columns)


def _classes(base: DataFrame, plain: bool, k: int, num: int, den: int) -> DataFrame:
    """base(__key, doc_id, text): doc_id, n_shingles, __key, __first."""
    ship(base.sparkSession)
    rec = materialize(records(base, k, num, den))
    reps = materialize(rec.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(KEY).alias("rep"), F.min("grade").alias("grade"), F.min("low").alias("low")))
    edges = materialize(families(rec.where("n > 0").select(KEY, "n", "keys"), num, den))
    family = components(edges)
    member = materialize(family.join(reps.withColumnRenamed("rep", "v"), "v").select("v", "root", "n", "grade", "low"))
    roots = links(base if plain else base.dropDuplicates([KEY]), member, k, num, den).withColumnRenamed("v", "rep")
    first = reps.join(roots, "rep", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("g"), F.coalesce("label", "rep").alias("__first"))
    same = (rec["f1"] == first["g1"]) & (rec["f2"] == first["g2"]) & (rec["n"] == first["g"])
    return rec.join(first, same, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), KEY, F.coalesce("__first", KEY).alias("__first"))


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs(doc_id, text): doc_id, n_shingles, component_id."""
    base, plain = keyed(docs.select("doc_id", "text"), KEY)
    out = _classes(base, plain, k, num, den)
    if plain:
        return out.select("doc_id", "n_shingles", F.col("__first").cast(dict(docs.dtypes)["doc_id"]).alias("component_id"))
    names = base.select(F.col(KEY).alias("__first"), F.col("doc_id").alias("component_id")).dropDuplicates(["__first"])
    return out.join(names, "__first").select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns kept, that come first in their component."""
    base, plain = keyed(plain_names(docs), KEY)
    first = _classes(base.select(KEY, "doc_id", "text"), plain, k, num, den).where(f"{KEY} = __first").select(F.col(KEY).alias("__kept"))
    kept = base.join(first, base[KEY] == F.col("__kept"), "left_semi")
    return (kept if plain else kept.dropDuplicates([KEY])).drop(KEY).toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b USING (p) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
reach(s, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT s, y FROM reach JOIN e ON v = x),
c AS (SELECT s AS doc_id, min(v) AS component_id FROM reach GROUP BY s)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
