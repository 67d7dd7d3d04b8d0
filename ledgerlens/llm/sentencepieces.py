"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; ``parse_model`` reads the fields it needs with a
small wire decoder. ``build`` then makes the same tokenizer out of parts:
normaliser (precompiled map, extra white space, dummy prefix), the metaspace
marker, unigram scores or BPE merges derived from the scores, and byte fallback.
If no piece has the marker after another character, text can be cut before each
run of markers without changing any result, which keeps long texts linear: words are
then encoded once, as long as they are kept, and texts are put together from them.

Defined cases: null and empty texts have no ids and decode to the empty string;
control pieces typed in a text are ordinary text; null and repeated ids are kept row
by row, ids of any type; repeated texts get the same ids; long texts are encoded
whole, few at once; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose ids a worker keeps, about 50 MB of them; beyond that it starts anew.
KEPT = 200_000
#: Words that the tokenizer gets as one text.
JOINED = 512
CUT = f"{MARK}*[^{MARK}]+|{MARK}+"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # remove_extra_whitespaces
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message, undecoded."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind}")
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("truncated message")
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    model = Model()
    for number, value in wire(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(wire(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(wire(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(wire(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if not model.pieces:
        raise ValueError("no pieces")
    if model.kind not in (UNIGRAM, BPE) or not model.escape:
        raise ValueError("only unigram and BPE models with escaped white space")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which BPE joins them: best score of the result first."""
    known = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    out = []
    for p, score, kind in model.pieces:
        if kind == NORMAL and len(p) > 1:
            out += [(-score, known[a], known[b], a, b) for a, b in ((p[:i], p[i:]) for i in range(1, len(p))) if a in known and b in known]
    return [(a, b) for *_, a, b in sorted(out)]


def build(model: Model):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        # other kinds of pieces never match text; a score this low loses always
        core = models.Unigram([(p, s if k in (NORMAL, USER) else -1e9) for p, s, k in model.pieces], unk, model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in model.pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(CUT), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else parts)
    if own := [AddedToken(p, normalized=True) for p, _, k in model.pieces if k == USER]:
        out.add_tokens(own)
    return out


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer, normalizers

        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.encode() for p, _, k in self.model.pieces]
        self.parts = pa.array(self.bytes, pa.large_binary())
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.heads = np.array([p[:1] == MARK for p, _, _ in self.model.pieces])
        self.known: dict[str, bytes] = {}
        self.words = None
        if self.tokenizer.pre_tokenizer is not None and all(k != USER for _, _, k in self.model.pieces):
            self.words = Tokenizer(self.tokenizer.model)  # the same model, of normal text
            self.words.pre_tokenizer = self.tokenizer.pre_tokenizer

    def normal(self, text: str) -> str:
        """What the tokenizer's normaliser makes of a text."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text)
            text = text[text[:1] == " " : len(text) - (text[-1:] == " ")]
        if self.model.dummy_prefix and text:
            text = MARK + text
        return text.replace(" ", MARK)

    def _learn(self, words: list[str]) -> None:
        """The ids of words, as bytes. Words of one marker at their start, where a piece
        then begins with it, are encoded as one text, which is cut there again."""
        joint, alone = [], []
        for w in words:
            (joint if w[0] == MARK != w[-1] and w.rfind(MARK) == 0 else alone).append(w)
        groups = [joint[s : s + JOINED] for s in range(0, len(joint), JOINED)]
        for group, e in zip(groups, self.words.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            cuts = 4 * np.flatnonzero(self.heads[ids])
            if len(cuts) != len(group):  # the marker is no piece
                alone += group
                continue
            data, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(group, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
        for word, e in zip(alone, self.words.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[word] = np.array(e.ids, np.int32).tobytes()

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's ids begin."""
        if self.words is None:
            ids = [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            if len(self.known) > KEPT:
                self.known.clear()
            lists = [re.findall(CUT, self.normal(t)) for t in texts]
            if new := set(chain.from_iterable(lists)).difference(self.known):
                self._learn(list(new))
            ids = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        at = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
        return np.frombuffer(b"".join(ids), np.int32), at

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.flat(texts)
        return [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])]

    def plain(self, data: bytes) -> str:
        text = data.decode(errors="replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        return self.plain(b"".join(map(self.bytes.__getitem__, ids)))

    def parity(self, texts: list[str], data: bytes) -> list[bool]:
        """Whether the sentencepiece library gives the same ids and text."""
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_proto=data)
        ours = self.encode(texts)
        return [a == b and self.decode(a) == other.decode(b) for a, b in zip(ours, other.encode(texts, num_threads=1))]


@lru_cache(2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, chunk: int = 64, threads: int = 2, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text): doc_id, ids (if kept), n_tokens, ids_sha256 (of the ids
    as decimal text joined by commas) and round_trip: decoding gives the text.

    The driver reads the model file and sends its bytes along; each worker
    encodes at most ``chunk`` texts, and a few MB of text, at a time in ``threads``
    threads.
    """
    ship(docs.sparkSession)
    data = read_model(path)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        c = codec(data)
        for some in text_slices(batches):
            for start in range(0, some.num_rows, chunk):
                part = some.slice(start, chunk)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, at = c.flat(texts)
                numbers, at = pa.array(ids), pa.array(at)
                decimal = pc.binary_join(pa.LargeListArray.from_arrays(at, numbers.cast(pa.large_string())), pa.scalar(",", pa.large_string()))
                back = pc.binary_join(pa.LargeListArray.from_arrays(at, c.parts.take(numbers)), pa.scalar(b"", pa.large_binary()))
                out = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pc.subtract(at[1:], at[:-1]),
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in decimal.cast(pa.large_binary()).to_pylist()],
                    "round_trip": [c.plain(b) == t for b, t in zip(back.to_pylist(), texts)],
                }
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(at.cast(pa.int32()), numbers)
                yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded(doc_id, ids): doc_id, text; null ids give the empty string."""
    ship(encoded.sparkSession)
    data = read_model(path)

    def run(batches):
        c = codec(data)
        for batch in batches:
            texts = [c.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": texts})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
