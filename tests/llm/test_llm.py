"""Text operators against SQL and brute force, with odd rows of every kind."""

import cProfile
import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import ann, common, decontaminate, html_text, jaccard_join, langid, maxent_lm, registry, sentencepieces, substring_dedup, toxicity, url_filters

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(common.UPPER, common.LOWER)
ODD = [
    (1, " ".join(f"w{i}" for i in range(60)), "en"), (2, " ".join(f"w{i}" for i in range(30, 90)), "en"), (3, None, None), (4, "", "de"), (5, "  \t\n", "de"),
    (6, " ".join(["same"] * 45), "en"), (7, " ".join(f"w{i}" for i in range(60)), "en"), (8, "Ä É " * 3000, "fr"), (9, "one", "fr"), (10, "ONE", None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("k", common.F.lit("x")).withColumn("h", common.F.lit(1))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    ours = registry.QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, cur.fetchall()))


def test_words_of_slices():
    whole = pa.array(["Ab c", None, " É d ", "x"] * 50)
    part = whole.slice(101, 60)
    flat, offsets = common.words_of(part, lower=True)
    want = [WORD.findall((t or "").translate(LOW)) for t in part.to_pylist()]
    assert [flat[a:b].to_pylist() for a, b in zip(offsets[:-1], offsets[1:])] == want


def brute_repeats(docs, width=20):
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark, odd):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(odd).collect()}
    assert got == brute_repeats([(d, t) for d, t, _ in ODD])
    assert substring_dedup.remove_repeats(odd).columns == odd.columns
    assert substring_dedup.digests(odd.limit(0)).count() == 0


def test_cover_holds_every_difference():
    for a in range(substring_dedup.PERIOD):
        assert any((a + s) % substring_dedup.PERIOD in substring_dedup.COVER and s % substring_dedup.PERIOD in substring_dedup.COVER for s in range(substring_dedup.PERIOD))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text, ""), (1, text, ""), (None, text, ""), (None, None, "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.digests(df).collect()) == [(0, 0), (0, 40), (1, 0), (1, 0)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.classes(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert jaccard_join.keep_first(df).count() == 2


@pytest.mark.parametrize("num", [85, 80])
def test_linked_sets_share_a_key(num):
    rng = np.random.default_rng(num)
    for _ in range(600):
        size = int(rng.integers(1, 300))
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        d = int(rng.integers(0, size * 0.2 + 2))
        r = min(int(rng.integers(0, d + 1)), size)
        b = np.unique(np.concatenate([a[: size - r], rng.integers(0, 2**64, d - r, dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        if both < union and both * 100 >= num * union:
            rows, keys = jaccard_join.bucket_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
            assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_signature_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(1, 80)), dtype=np.uint64)
        sets += [np.unique(base[rng.random(len(base)) < 0.95]) for _ in range(4)]
    sets = [s for s in sets if len(s)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert jaccard_join.link_family(sets, 85, 100)[0].tolist() == label


def brute_components(docs, k, num):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both * 100 >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return label


@pytest.mark.parametrize("leaf", [1 << 18, 400])
def test_components_with_leaves_of_any_size(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng, docs = np.random.default_rng(3), []
    for g in range(4):
        base = rng.integers(0, 300, int(rng.integers(30, 100)))
        for c in range(40 if g else 12):  # near copies of one text, then a chain that drifts away from it
            near = base.copy()
            near[rng.integers(0, len(base), int(rng.integers(0, 4)))] = rng.integers(0, 300)
            docs.append(near)
        for c in range(15):
            base = base.copy()
            base[rng.integers(0, len(base))] = rng.integers(0, 300)
            docs.append(base)
    docs = [(i, " ".join(f"w{x}" for x in d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute_components(docs, 5, 80)


def test_components_of_odd_rows(spark, odd):
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(odd).collect()}
    assert got == brute_components([(d, t) for d, t, _ in ODD], 4, 85)


def brute_decontamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out[d] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("rows", [500_000, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, rows):
    """With one chunk of windows, and with many; no join is broadcast but for these."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs, items = (common.table(spark, DATA, t).select(n, "text") for t, n in (("documents", "doc_id"), ("benchmark", "item_id")))
    more = [(1000, "The of"), (1001, "of"), (1002, None), (1003, " . "), (None, "the"), (1004, "of the of the of the of the of the of the")]
    items = items.union(spark.createDataFrame(more, "item_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute_decontamination(docs.collect(), items.collect())


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "ONE"), (2, None), (3, ""), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "w1")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(odd, items).where("contaminated").collect()}
    assert got == {1: (11, ["4"]), 7: (11, ["4"]), 9: (1, ["1"]), 10: (1, ["1"])}
    assert decontaminate.decontaminate(odd, items).columns == odd.columns


def test_urls(spark):
    rows = [(1, None), (2, "nothing"), (3, "HTTP://A.Net/de/8?x"), (4, "http://b.example.net/de/8#"), (5, "http://xnet/de/"), (6, "x://com?")]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    good = spark.createDataFrame([(1, None), (None, 1)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(urls, good).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/de/8", "net/de/", "allow"), 4: ("b.example.net", "/de/8", "example.net/de/8", "block"), 5: ("xnet", "/de/", None, "allow"), 6: ("com", "", None, "allow")}


def test_bad_hosts_are_blocked(spark):
    urls = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(400)], "page_id long, url string")
    good = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "page_id long, good int")
    assert {(r.host, r.verdict) for r in url_filters.judge(urls, good).collect()} == {("bad.org", "block"), ("good.org", "allow")}


def test_batches_to_workers_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    common.ship(spark)
    texts = spark.range(0, 9000, 1, 1).select(common.F.repeat(common.F.lit("word "), 400).alias("text"))
    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 9000 and max(r.bytes for r in got) < common.BATCH_BYTES + 100_000


def test_language_model_base_score_and_gain(spark):
    rows = maxent_lm.op2_maxent_lm(spark, DATA).collect()
    docs = {r.doc_id: WORD.findall((r.text or "").translate(LOW)) + ["\n"] for r in common.table(spark, DATA, "documents").collect()}
    c = Counter(w for d, ws in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        assert r.n_tokens == len(docs[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in docs[r.doc_id]) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in docs[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def lm_vocabulary(docs):
    return maxent_lm.vocabulary(maxent_lm.count_tokens(docs))


def test_language_model_learns_from_every_position(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(40)], "__key long, text string")
    v = lm_vocabulary(docs)
    n = 40 * 5
    part = pa.RecordBatch.from_pydict({"text": docs.toPandas()["text"].tolist()})
    cells = maxent_lm.seen_cells(v, part)
    assert (cells < maxent_lm.BUCKETS * maxent_lm.CLASSES).sum() == 3 * n
    start, w = maxent_lm.Weights.initial(v), maxent_lm.train(docs, v)
    place, kind, h = v.look_up(maxent_lm.with_ends(part)[0])
    offsets = np.arange(0, n + 1, 5)
    outer, inner = maxent_lm.features(h, offsets)
    before, after = (maxent_lm.log_probability(x, v, place, kind, outer, inner) for x in (start, w))
    assert (after != before).all() and after.sum() > before.sum()  # no position is left as it was; hashes may collide


def test_language_model_of_any_partitions(spark):
    rows = [(i, " ".join(f"{'hot' if i < 5 else 'w'}{j % 7}" for j in range(i % 9 + 5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "__key long, text string")
    v = lm_vocabulary(docs)
    one, many = maxent_lm.train(docs.coalesce(1), v), maxent_lm.train(docs.repartition(30, "__key"), v)
    assert (one.outer == many.outer).all() and (one.inner == many.inner).all()


def test_language_model_steps_on_expectations_of_its_softmaxes(spark):
    """Each step against sums of plain softmaxes over every position; the likelihood rises."""
    texts = [" ".join(f"w{(i * j + j) % (40 + i)}" for j in range(i % 23)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "__key long, text string")
    v = lm_vocabulary(docs)
    steps = [maxent_lm.train(docs, v, rounds) for rounds in (1, 2, 3)]
    assert (maxent_lm.train(docs, v).outer == steps[maxent_lm.ROUNDS - 1].outer).all() and maxent_lm.ROUNDS > 1
    flat, offsets = maxent_lm.with_ends(pa.RecordBatch.from_pydict({"text": texts}))
    place, kind, h = v.look_up(flat)
    outer, inner = maxent_lm.features(h, offsets)
    total = [maxent_lm.log_probability(w, v, place, kind, outer, inner).sum() for w in (maxent_lm.Weights.initial(v), *steps)]
    assert total == sorted(total)
    begin = maxent_lm.Weights.initial(v)
    for w, after in zip(steps, steps[1:]):
        cells = [(w.outer, after.outer, begin.outer[:1], outer, kind)]
        head = kind < maxent_lm.HEAD_CLASSES
        rows = inner[head] * maxent_lm.HEAD_CLASSES + kind[head, None]
        first = np.tile(begin.inner[: maxent_lm.HEAD_CLASSES], (maxent_lm.INNER_BUCKETS, 1))
        cells.append((w.inner, after.inner, first, rows, place[head] % maxent_lm.CLASS_SIZE))
        for old, new, bias, at, gold in cells:
            seen, expected = np.zeros(old.shape), np.zeros(old.shape)
            for r, g in zip(at, gold):
                a = np.exp(old[r].astype(float).sum(0))
                for j in r[1:]:
                    seen[j, g] += 1
                    expected[j] += a / a.sum()
            n, p = seen.sum(1, keepdims=True), np.exp(bias.astype(float))
            p /= p.sum(1, keepdims=True)
            want = old + np.log((seen + 20 * p) / (expected + 20 * (expected + p) / (n + 1))) / 3
            off = np.abs(new - want)[np.broadcast_to(p, new.shape) > 1e-5]  # smaller ones are rounded
            moved = np.abs(new - old)[np.broadcast_to(p, new.shape) > 1e-5] > 1e-3
            assert moved.any() and off.max() < 0.1 and off[moved].mean() < 0.01


def test_probabilities_of_the_vocabulary_sum_to_one(spark):
    """After each history: all counted tokens, and one unknown token a tail class."""
    rows = [(i, " ".join(f"{'ab'[j % 2]}{(i * j) % (900 + i)}{'xyz'[(i + j) % 3]}" for j in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "__key long, text string")
    v = lm_vocabulary(docs)
    assert len(v.tokens) > maxent_lm.HEAD
    w = maxent_lm.train(docs, v)
    n, tail = len(v.tokens), maxent_lm.TAIL_CLASSES
    place = np.concatenate([np.arange(n), np.full(tail, -1)])
    kind = np.concatenate([v.kind, np.arange(tail) + maxent_lm.HEAD_CLASSES])
    for text in ("a1x b2y", "never seen", ""):
        flat, offsets = maxent_lm.with_ends(pa.RecordBatch.from_pydict({"text": [text]}))
        outer, inner = maxent_lm.features(v.look_up(flat)[2], offsets)
        last = lambda x: np.tile(x[-1:], (len(place), 1))
        p = np.exp(maxent_lm.log_probability(w, v, place, kind, last(outer), last(inner)))
        assert abs(p.sum() - 1) < 1e-3


def test_scores_equal_brute_force(spark):
    """The query's score, one token at a time with plain softmaxes."""
    docs = common.table(spark, DATA, "documents").limit(60).cache()
    out = common.crc_mod("doc_id", 7) == 2
    v = maxent_lm.vocabulary(maxent_lm.count_tokens(docs.where(~out)))
    w = maxent_lm.train(docs.where(~out).withColumn("__key", common.F.col("doc_id")), v)
    known = {t: i for i, t in enumerate(v.tokens.to_pylist())}
    got = {r.doc_id: r.score for r in maxent_lm.score(docs, out).collect()}
    for r in docs.collect()[:12]:
        tokens, total = WORD.findall((r.text or "").translate(LOW)) + ["\n"], 0.0
        flat, offsets = maxent_lm.with_ends(pa.RecordBatch.from_pydict({"text": [r.text]}))
        outer, inner = maxent_lm.features(maxent_lm.word_hashes(flat), offsets)
        for j, t in enumerate(tokens):
            i = known.get(t, -1)
            c = int(v.kind[i]) if i >= 0 else int(maxent_lm.tail_class([t])[0])
            a = w.outer[outer[j]].astype(float).sum(0)
            total += a[c] - math.log(np.exp(a).sum())
            if c < maxent_lm.HEAD_CLASSES:
                a = w.inner[inner[j] * maxent_lm.HEAD_CLASSES + c].astype(float).sum(0)
                total += a[i % maxent_lm.CLASS_SIZE] - math.log(np.exp(a).sum())
            else:
                k = c - maxent_lm.HEAD_CLASSES
                total += math.log(((v.counts[i] if i >= 0 else 0) + 1) / (v.tail_n[k] + v.tail_v[k] + 1))
        assert math.isclose(got[r.doc_id], total / math.log(10), rel_tol=1e-4)


def test_language_model_of_odd_rows(spark, odd):
    more = odd.union(odd.where("doc_id IN (1, 4)")).union(odd.where("doc_id = 9").withColumn("doc_id", common.F.lit(None).cast("long"))).withColumn("score", common.F.lit("x"))
    got = maxent_lm.score(more, common.F.col("doc_id") == 7).collect()
    assert len(got) == len(ODD) + 3 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert maxent_lm.score(more.limit(0), common.F.col("doc_id") == 7).count() == 0


def test_both_softmaxes_have_every_feature():
    # texts (1, 2, 3) and (9, 2, 3): the last histories differ two tokens back alone
    for rows in maxent_lm.features(np.array([1, 2, 3, 9, 2, 3], np.uint64), np.array([0, 3, 6])):
        assert rows.shape == (6, 4) and (rows[:, 0] == 0).all()
        assert rows[2, 1] == rows[5, 1] and rows[2, 2] != rows[5, 2] and rows[2, 3] != rows[5, 3]


def test_language_model_takes_no_step_a_word_and_no_flush_a_chunk(monkeypatch):
    """Words that a task hasn't met are looked up together; the sums of softmaxes are
    moved to wide numbers when a row of the weights is full, not after so many positions."""
    tokens = ["\n", *(f"w{i}" for i in range(3000))]
    v = maxent_lm.Vocabulary(tokens, [9] * 3001, 30_000, 3001, np.ones(32), np.ones(32))
    flat = pa.array([f"w{i}é" if i % 2 else f"w{i}" for i in range(20_000)], pa.large_string())
    calls = cProfile.Profile()
    place, kind, h = calls.runcall(v.look_up, flat)
    assert sum(x.callcount for x in calls.getstats()) < 5000
    assert place.tolist() == [-1 if i % 2 or i >= 3000 else i + 1 for i in range(20_000)] and len(set(h.tolist())) == 20_000
    rest = np.flatnonzero(place < 0)
    assert kind[rest].tolist() == [zlib.crc32(flat[i].as_py()[-2:].encode()) % 32 + 32 for i in rest.tolist()]
    flushes, plain = [], maxent_lm.Expected._flush
    monkeypatch.setattr(maxent_lm.Expected, "_flush", lambda self, which: (flushes.append(which), plain(self, which)))
    sums = maxent_lm.Expected(v, maxent_lm.Weights.initial(v))
    text = lambda r: " ".join(f"w{(i * 7919 + r) % 9973}" for i in range(8000))
    for r in range(10):
        sums.add(pa.RecordBatch.from_pydict({"text": [text(r)]}))
    total = sums.done()
    assert len(flushes) == 2  # both at the end
    assert abs(total[: maxent_lm.BUCKETS * maxent_lm.CLASSES].sum() / maxent_lm.UNIT / (3 * 80_010) - 1) < 1e-3


def test_word_hashes_are_of_the_word_alone():
    """Wherever a word stands, in whatever block; long words take no memory by the byte."""
    long = ["x" * n for n in (maxent_lm.HASHED - 1, maxent_lm.HASHED, maxent_lm.HASHED + 1, 2_000_000)]
    words = ["", "a", "a\0", "é", *long[:2], "b", *long[2:], *(f"w{i}" for i in range(80_000)), "aa"]
    got = maxent_lm.word_hashes(pa.array(words))
    assert len(set(got.tolist())) == len(words)
    some = [*range(12), 40_000, len(words) - 1]
    assert [maxent_lm.word_hashes(pa.array([words[i]]))[0] for i in some] == got[some].tolist()
    assert (maxent_lm.word_hashes(pa.array(words, pa.large_string()).slice(5, 70_000)) == got[5:70_005]).all()
    plain = sum((b + 1) * pow(maxent_lm.BASE, i, 1 << 64) for i, b in enumerate("é".encode())) % (1 << 64)
    assert got[3] == maxent_lm.mix(np.array([plain], np.uint64))[0]
    tracemalloc.start()
    maxent_lm.word_hashes(pa.array(["x" * 20_000_000]))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_language_model_sums_beyond_32_bits():
    v = maxent_lm.Vocabulary(["\n", "a"], [10, 3_000_000], 3_000_010, 2, np.zeros(32), np.zeros(32))
    w = maxent_lm.Weights.initial(v)
    sums = maxent_lm.Expected(v, w)
    for _ in range(3):
        sums.add(pa.RecordBatch.from_pydict({"text": ["a " * 100_000]}))
    got = sums.done()[: w.outer.size].reshape(w.outer.shape) / maxent_lm.UNIT
    assert got.sum(1).max() > 3 * 99_000 and abs(got.sum() / (9 * 100_001) - 1) < 1e-4
    p = np.exp(w.outer[0].astype(float))
    assert np.abs(got.sum(0) / got.sum() - p / p.sum()).max() < 1e-4


def test_softmaxes_of_extreme_weights():
    """Shares and their logarithms where products of exponentials leave their type."""
    rng = np.random.default_rng(0)
    w = (rng.normal(size=(64, 8)) * np.repeat([1, 20, 60, 200], 16)[:, None]).astype(np.float32)
    soft = maxent_lm.Softmax(w, 4)
    at = np.stack([np.arange(1000) % 4, *(rng.integers(1, 16, (3, 1000)) * 4 + np.arange(1000) % 4)], 1)
    gold = rng.integers(0, 8, 1000)
    want = maxent_lm.log_softmax(w[at].astype(float).sum(1))
    assert np.abs(soft.shares(at) - np.exp(want)).max() < 1e-3
    assert np.allclose(soft.log_share(at, gold), want[np.arange(1000), gold], rtol=1e-4, atol=1e-3)
    assert want.min() < -200


def test_html():
    page = "<nav><a href=/>Menu</a></nav><article><h1>A &amp; b</h1><p>One two.<p>x < y<script>no</script></article><div class=comments><p>the cat of the dog is in the house and on it</p></div><footer>&copy;</footer>"
    assert html_text.extract(page) == "A & b\nOne two.\nx < y"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x") == ""


def test_html_long_tags():
    long = "<article><p>One two.</p><img src=data:" + "x" * 50_000 + "><object data=" + "y" * 50_000 + ">no</object><p>Three.</p></article>"
    assert html_text.extract(long) == html_text.extract("<article><p>One two.</p><img><object>no</object><p>Three.</p></article>") == "One two.\nThree."


def all_text(page):
    """The text outside of tags, one character at a time, for a page without raw
    elements; blocks and what is refused don't matter here."""
    out, at = [], 0
    while at < len(page):
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            at = len(page) if stop < 0 else stop + 3
        elif re.match(r"<[!?]|</(?![a-zA-Z])", page[at : at + 3]):
            stop = page.find(">", at)
            at = len(page) if stop < 0 else stop + 1
        elif re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            i, ends = re.compile(r"</?[^\s/>]*").match(page, at).end(), None
            first = page.find(">", i)
            while i < len(page):
                if page[i] == ">":
                    ends = i
                    break
                quoted = re.compile(r"=\s*([\"'])").match(page, i)
                if quoted:
                    stop = page.find(quoted[1], quoted.end())
                    if stop < 0:
                        ends = page.find(">", quoted.end())
                        break
                    i = stop
                i += 1
            ends = first if ends is None or ends < 0 else ends
            at = len(page) if ends < 0 else ends + 1
            out.append("\0")
        else:
            out.append(page[at])
            at += 1
    return "".join(out)


def test_html_tags_equal_brute_force():
    rng = np.random.default_rng(8)
    bits = ["<p>", "<p ", "<b", "</b>", "</", "<!--", "-->", "<!x", "<3", "=", '"', "'", ">", "<a href=", "x", " y ", "/>", "<img alt='>'", "<div class=\"k\">", "</div>"]
    for _ in range(4000):
        page = "".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(1, 25))))
        tags, at, got = html_text.Tags(page), 0, []
        while m := tags.token(at):
            got.append(page[at : m[0]])
            if m[2]:
                got.append("\0")
            at = m[1]
        assert "".join(got) + page[at:] == all_text(page), page


@pytest.mark.parametrize("piece", ["<p ", '<p ="', '<a "', "<a '\"", "<a =\"'", "<!x", "</ ", "<!--", "&", "<", '<a =">"', "<span class=ad>x", "<div>", "<script>x</script "])
def test_html_takes_linear_time(piece):
    began = time.process_time()
    html_text.extract(piece * 100_000)
    assert time.process_time() - began < 10


def test_html_of_odd_rows(spark):
    good = "<article><p>" + "the cat of the dog is in the house and on it. " * 20_000 + "</p></article>"
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>" + "x" * 10), (3, "u", good), (4, "u", '<article><p>One.</p><b class="x>Two</b><p>Three.</p></article>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", common.F.lit(1)).withColumn("n_chars", common.F.lit(None).cast("string"))
    got = html_text.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got if r.page_id in (1, 2, None)) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert [r.text for r in got if r.page_id == 3] == ["the cat of the dog is in the house and on it. " * 19_999 + "the cat of the dog is in the house and on it."]
    assert [r.text for r in got if r.page_id == 4] == ["One.\nTwo\nThree."]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_language_id(spark, odd):
    out = langid.op6_language_id(spark, DATA).join(common.table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out AND lang = lang_pred").count() >= 0.95 * out.where("held_out").count()
    model = langid.train(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[3] == got[4] == got[5] == langid.UND
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd.limit(0))).collect()} == {langid.UND}


def test_languages_equal_brute_force(spark):
    """The decoded codeword and its probability from plain sums over n-grams."""
    docs = common.table(spark, DATA, "documents")
    model = langid.train(docs.where(~langid.held_out(4, 2)))
    got = {r.doc_id: r for r in langid.op6_language_id(spark, DATA).collect()}
    for r in docs.collect()[:60]:
        grams = np.concatenate(langid.buckets_of(np.frombuffer((" " + (r.text or "").lower() + " ").encode(), np.uint8)))
        margins = [model.scale * sum(float(model.weights[g, b]) for g in grams) / len(grams) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word)) for word in model.code]
        p = [math.exp(min(loss) - x) for x in loss]
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == model.langs[int(np.argmin(loss))] and math.isclose(got[r.doc_id].score, max(p) / sum(p), rel_tol=1e-6)


def test_languages_of_odd_rows(spark, odd):
    rows = odd.union(odd).withColumn("score", common.F.lit("kept")).union(spark.createDataFrame([(None, "x" * 1_500_000, "en", "x", 1, "kept")], odd.schema.simpleString()[7:-1].replace(":", " ") + ", score string"))
    got = langid.identify(rows, langid.train(rows)).collect()
    assert len(got) == 2 * len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert all(len({r.lang_pred for r in got if r.doc_id == d}) == 1 for d, _, _ in ODD)


def test_pieces_equal_the_library(spark):
    data = sentencepieces.read_model()
    texts = [r.text for r in common.table(spark, DATA, "documents").collect()] + ["", "  a  b ", "<s> x", "日本 🎉", "\n\t\0", "▁▁a"]
    assert all(sentencepieces.Codec(data).parity(texts, data))


def test_pieces_of_odd_rows(spark, odd):
    coded = sentencepieces.encode(odd)
    assert {r.doc_id: r.n_tokens for r in coded.collect()}[3] == 0
    assert {r.doc_id: r.text for r in sentencepieces.decode(coded).collect()} == {d: t or "" for d, t, _ in ODD}


def test_neighbours(spark):
    big = DATA.replace("0.001", "0.1")
    vectors = common.table(spark, big, "embeddings")
    rows = ann.search(vectors).collect()
    pdf = vectors.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        got = [r for r in rows if r.query_id == ids[q]]
        assert all(math.isclose(r.score, d[list(ids).index(r.vec_id)], rel_tol=1e-9) for r in got[:2])
        hit, total = hit + len(want & {r.vec_id for r in got}), total + len(want)
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (None, [1.0, 1.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0)]


def test_partitions_and_probes(spark):
    """Vectors in clumps: few partitions are visited, and the neighbours are found."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 16)) * 4, 100, 0) + rng.normal(size=(4000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    router, probes = ann.fit(ann.usable(df), 4000, 10, 0.93)
    assert probes <= 4
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for _, v, _ in got[q]} & set(np.lexsort((np.arange(4000), d))[:10]))
        assert all(math.isclose(s, d[v], rel_tol=1e-9) for _, v, s in got[q]) and [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
    assert hits >= 0.9 * 400


def test_vectors_with_ties_and_repeats(spark):
    rows = [(i, [float(i // 4), 1.0]) for i in range(0, 40)] + [(100, [0.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", common.F.lit("x")).withColumn("parts", common.F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, k=5).collect() if r.query_id == 100]
    assert sorted(got) == [(100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 3, 0.0), (100, 5, 4, 1.0)]
    assert ann.search(df.limit(0)).count() == 0


CLASH = ["__key", "__k", "__spans", "__kept", "_bad", "_bad_h", "h", "k", "v", "root", "leaf", "key", "d", "g", "c0", "n_chars", "score", "ids"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(d, t, *([f"{d}"] * len(CLASH))) for d, t, _ in ODD] + [(1, ODD[0][1], *(["again"] * len(CLASH))), (None, "one two", *([None] * len(CLASH))), (20, "very long " * 150_000, *(["x"] * len(CLASH)))]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, schema).withColumn("n_chars", common.F.length("text").cast("long"))


def stages(spark):
    items = spark.createDataFrame([(4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "w1"), (5, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    return {
        "toxicity": lambda df: toxicity.keep_clean(df, labels), "near_duplicates": jaccard_join.keep_first,
        "repeated_passages": substring_dedup.remove_repeats, "decontamination": lambda df: decontaminate.decontaminate(df, items),
    }


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "repeated_passages", "decontamination"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_keep_columns_of_any_name(spark, clashing, name, kind):
    df = clashing.withColumn("doc_id", common.F.col("doc_id").cast(kind))
    out = stages(spark)[name](df)
    assert out.schema.simpleString() == df.schema.simpleString()
    rows = out.collect()
    assert rows and all(r[c] == r["score"] for r in rows for c in CLASH if c != "n_chars")
    assert stages(spark)[name](df.limit(0)).count() == 0
    ids = sorted(int(r.doc_id) if r.doc_id is not None else -1 for r in rows)
    want = {"near_duplicates": [-1, 1, 2, 3, 4, 5, 6, 8, 9, 20], "repeated_passages": [-1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20], "decontamination": [-1, 2, 3, 4, 5, 6, 8, 9, 10, 20]}
    if name in want and kind == "long":
        assert ids == want[name]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_operators_of_any_names_and_ids(spark, clashing, kind):
    df = clashing.withColumn("doc_id", common.F.col("doc_id").cast(kind))
    n = df.count()
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for out in (
        sentencepieces.encode(df), substring_dedup.digests(df), jaccard_join.classes(df), decontaminate.contamination(df, items), maxent_lm.score(df, common.F.col("doc_id") == "7"),
        langid.identify(df, langid.train(df.withColumn("lang", common.F.lit("en")))),
    ):
        assert dict(out.dtypes)["doc_id"] == ("bigint" if kind == "long" else kind)
        assert out.count() == n
    empty = df.limit(0)
    assert sentencepieces.encode(empty).count() == decontaminate.contamination(empty, items).count() == jaccard_join.classes(empty).count() == 0
    assert decontaminate.contamination(df, items.limit(0)).where("contaminated").count() == 0


def test_urls_of_odd_tables(spark):
    urls = spark.createDataFrame([(1, "x://a.com/1", "q"), (1, "x://a.com/1", "q"), (None, "x://a.com/", None), (2, "x://" + "h" * 1_200_000, "q")], "page_id long, url string, host string").withColumn("rule", common.F.lit(1)).withColumn("n", common.F.lit(1))
    good = spark.createDataFrame([(1, 0), (1, 1), (None, 0)], "page_id long, good int")
    got = url_filters.judge(urls, good).collect()
    assert len(got) == 4 and len({r.verdict for r in got if r.page_id == 1}) == 1
    assert url_filters.judge(urls.limit(0), good).count() == 0 and url_filters.judge(urls, good.limit(0)).where("verdict = 'allow'").count() == 4


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://somewhere:7077", raising=False)
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            common.shared_dir(spark)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = common.materialize(stage(spark, step, DATA))
        if name != "encoding":
            assert step.columns == docs.columns
    assert step.where("NOT round_trip").count() == 0
    assert sorted(map(repr, step.collect())) == sorted(map(repr, corpus_pipeline.run(spark, DATA).collect()))
