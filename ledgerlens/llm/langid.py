"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier over
hashed character n-grams predicts it; decoding weighs each bit by its loss and
takes the nearest codeword, and a small margin over the second marks the text as
ambiguous. Up to six languages get the exhaustive code, of 31 bits at most, more get
the best of some random codes by smallest distance.

The classifiers are fitted on the driver to a bounded sample of labelled rows,
``sample_rows`` by language on average, chosen by hash; statistics of the sample
come as sparse rows. Every text is scored whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and are not learned from; null languages are not learned from; with one learned
language that is the answer, with none the answer is ``und``; repeated rows are
judged alike; null ids are judged and, as the sample is drawn by id, not learned
from; long texts are scored whole, one at a time; extra columns, whatever their
names, are kept if asked for and else left out.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh, ship, table, text_slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UND = "und"


def buckets_of(data: np.ndarray) -> list[np.ndarray]:
    """For each n the bucket of the n bytes that begin at each byte."""
    x = data.astype(np.uint32)
    out = []
    key = np.zeros(len(x), np.uint32)
    for n in ORDERS:
        if len(x) < n:
            break
        key = (key[: len(x) - n + 1] * np.uint32(257)) + x[n - 1 :]
        h = (key ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        out.append((h >> np.uint32(17)).astype(np.int32))
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each between two spaces; their offsets;
    and which texts have a letter."""
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    padded = pc.binary_join_element_wise(none, pc.utf8_lower(fresh(texts)), none, space).cast(pa.large_binary())
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], lettered


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By row: buckets and root-scaled frequencies (unit length)."""
    data, offsets, lettered = bytes_of(texts)
    ids, values = [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        found = buckets_of(data[a:b])
        i, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, int))
        ids.append(i.astype(np.int32))
        values.append((n / max(1, n.sum())).astype(np.float32))
    return ids, values, lettered


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        bits = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(bits, np.float32).T
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, width)).astype(np.float32)
        apart = (width - code @ code.T) / 2 + width * np.eye(k)
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, scale: float) -> None:
        self.langs, self.code, self.weights, self.bias, self.scale = langs, code, weights, bias, scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codeword of least logistic loss, its probability, and the lead."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return loss.argmin(1), p.max(1), order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of a text's n-grams, by row and bit."""
        out = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            used, n = np.unique(np.concatenate(buckets_of(data[a:b]) or [np.empty(0, np.int32)]), return_counts=True)
            out[r] = n @ self.weights[used].astype(float) / max(1, n.sum()) * self.scale + self.bias
        return out


def fit(ids: list[np.ndarray], values: list[np.ndarray], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 3) -> Model:
    """AdaGrad on the logistic loss of all bits at once, over sparse rows."""
    names = sorted(set(langs))
    code = codewords(len(names))
    target = code[[names.index(x) for x in langs]] if langs else np.empty((0, code.shape[1]))
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]), 1.0)
    share = {n: langs.count(n) for n in names}
    weight = np.array([len(langs) / (len(names) * share[x]) for x in langs])
    scale = 50.0
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    gw, gb = np.full(w.shape, 1e-6, np.float32), np.full(b.shape, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for s in range(0, len(order), 32):
            rows = order[s : s + 32]
            used, where = np.unique(np.concatenate([ids[r] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows]), where] = np.concatenate([values[r] for r in rows])
            m = scale * (x @ w[used]) + b
            g = -target[rows] / (1 + np.exp(target[rows] * m)) * weight[rows][:, None] / len(rows)
            step = scale * (x.T @ g).astype(np.float32)
            gw[used] += step * step
            w[used] -= rate * step / np.sqrt(gw[used])
            gb += g.sum(0) ** 2
            b -= rate * g.sum(0) / np.sqrt(gb)
    return Model(names, code, w, b, scale)


def train(rows: DataFrame, sample_rows: int = 500) -> Model:
    """rows(doc_id, text, lang): about ``sample_rows`` by language, by hash."""
    ship(rows.sparkSession)
    rows = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages
    if not counts:
        return fit([], [], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(draw < share[F.col("lang")])

    def run(batches):
        for batch in text_slices(batches):
            ids, values, _ = features(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "ids": pa.array(ids, pa.list_(pa.int32())), "vals": pa.array(values, pa.list_(pa.float32())), "doc_id": batch.column("doc_id").cast(pa.string())})

    got = chosen.select("doc_id", "text", "lang").mapInArrow(run, "lang string, ids array<int>, vals array<float>, doc_id string").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    ids = [np.asarray(x.values) for x in got["ids"]]
    return fit(ids, [np.asarray(x.values) for x in got["vals"]], got["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, least_lead: float = 0.2, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, and the columns named in ``keep``): lang_pred, score,
    ambiguous. The model is a few MB and goes along with the code."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *keep]

    def run(batches):
        m = shared.value
        for some in text_slices(batches):
            for start in range(0, some.num_rows, 512):
                part = some.slice(start, 512)
                data, offsets, lettered = bytes_of(part.column("text"))
                lettered = lettered & bool(m.langs)
                best, p, lead = m.decode(m.margins(data, offsets)) if m.langs else (np.zeros(len(lettered), int), *[np.zeros(len(lettered))] * 2)
                out = {c: part.column(c) for c in kept}
                out["lang_pred"] = [m.langs[i] if ok else UND for i, ok in zip(best, lettered)]
                out["score"] = np.where(lettered, p, 0.0)
                out["ambiguous"] = pa.array((lead < least_lead) | ~lettered)
                yield pa.RecordBatch.from_pydict(out)

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", lang_pred string, score double, ambiguous boolean"
    return docs.select(*kept, "text").mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
