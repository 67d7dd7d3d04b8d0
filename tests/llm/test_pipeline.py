"""The pipeline against the five stages in plain Python, and unigram pieces."""

import random
import struct
import sys
import zlib
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

from test_llm import LOW, WORD, brute_components, brute_decontamination  # noqa: E402
from test_toxicity import brute as brute_toxicity  # noqa: E402

import corpus_pipeline  # noqa: E402
from ledgerlens.llm import common, sentencepieces  # noqa: E402

DATA = "/root/testdata/sf0.001"


def without_repeats(docs, width=20):
    seen, out = set(), {}
    for d, text in sorted(docs.items()):
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
    return out


def test_pipeline_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, DATA, "documents").collect()}
    labels = {}
    for r in common.table(spark, DATA, "labels").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic is not None:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    scores = brute_toxicity(docs, labels)
    kept = {d: t for d, t in docs.items() if scores[d][0] < 0.5}
    assert 0 < len(kept) < len(docs)
    first = brute_components(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if first[d] == d}
    kept = without_repeats(kept)
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    hits = brute_decontamination(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not hits[d][1]}
    pieces = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.read_model())
    want = {d: pieces.encode(t or "") for d, t in kept.items()}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()} == want
    assert LOW


def message(*fields):
    """A protobuf message of (number, value): text, float, integer or message."""
    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += bytes([n << 3 | 5]) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += (bytes([n << 3]) if n < 16 else bytes([n << 3 & 127 | 128, n >> 4])) + bytes([v])
        else:
            v = v.encode() if isinstance(v, str) else v
            size = bytes([len(v)]) if len(v) < 128 else bytes([len(v) & 127 | 128, len(v) >> 7])
            out += bytes([n << 3 | 2]) + size + v
    return out


def test_unigram_pieces():
    """A unigram model written by hand, with scores that leave no ties: the ids are
    those of the library, and those of the best sum of scores."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))).lstrip("▁") for _ in range(60)} - {""})
    words = [w for w in words if "▁" not in w[1:]] + [f"▁{w}" for w in words[:20] if "▁" not in w] + ["▁"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, -rng.random() * 9 - 1, 1) for w in dict.fromkeys(words)]
    data = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((1, "identity"), (3, 1), (4, 1), (5, 1))))
    codec = sentencepieces.Codec(data)
    assert codec.model.kind == sentencepieces.UNIGRAM and codec.model.byte_fallback
    texts = ["".join(rng.choice("aabbcc ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", "a  b", "abé", "日 a"]
    assert all(codec.parity(texts, data))
    scores = {p: s for p, s, k in pieces if k == 1}
    for text, ids in list(zip(texts, codec.encode(texts)))[:300]:
        marked = "▁" + " ".join(text.split()).replace(" ", "▁") if text.split() else ""
        best = [0.0] + [-1e9] * len(marked)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + 6) + 1):
                if marked[i:j] in scores:
                    best[j] = max(best[j], best[i] + scores[marked[i:j]])
        if best[-1] > -1e8:
            assert abs(sum(pieces[i][1] for i in ids) - best[-1]) < 1e-4


def test_words_are_encoded_once(monkeypatch):
    """Texts put together from words that are kept have the library's ids, whatever is
    forgotten in between, and a word that is kept isn't encoded again."""
    data = sentencepieces.read_model()
    codec = sentencepieces.Codec(data)
    mark = sentencepieces.MARK
    odd = ["", " ", "  ", mark, f"{mark}{mark}a b{mark}", f"{mark} {mark}a", f"x  {mark}{mark} y ", "a \n b", "\n a ", "日本 é\x00x", "a\u3000b", "<s> </s> <unk>", "a" * 5000 + " b"]
    docs = [t for t in dict.fromkeys(odd)]
    rng = random.Random(2)
    docs += [" ".join("".join(rng.choice("abcdeé1&日") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [e.ids for e in codec.tokenizer.encode_batch_fast(docs, add_special_tokens=False)]
    assert all(codec.parity(docs, data))
    asked = []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda words: (asked.extend(words), learn(words)))
    assert codec.encode(docs) == want and not asked
    monkeypatch.setattr(sentencepieces, "KEPT", 50)
    assert [i for s in range(0, len(docs), 7) for i in codec.encode(docs[s : s + 7])] == want
    assert asked
