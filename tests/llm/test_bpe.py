import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelkit.llm import bpe, queries, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(len(x.ids), np.array(x.ids, "<u4").tobytes(), tokenizer.decode(x.ids, skip_special_tokens=False)) for x in found]


def sample():
    rng = random.Random(4)
    odd = ["'S", "don't", "éx", " ", "　wide", "<|endoftext|>", "<|startoftext|>x", "ΣΑΣ", "İ", "ﬁ", "日本語", "a\x1cb", "́x", "🙂🙂", "x\x85y", "12345", "&&&%%%"]
    passages = [" ".join(rng.choice(["the", "Of", "und", *odd]) for _ in range(400)) for _ in range(4)]
    texts = [None, "", "   \n", "a", "🙂" * 9000, "x" * 30_000, " ".join(odd) * 300]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 900))) for _ in range(4)]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    return texts + texts[:20]


def test_equals_the_library(frame):
    texts = sample()
    got = bpe.encode(frame(list(enumerate(texts))).withColumnRenamed("block", "ids"), PATH).collect()
    assert set(got[0].asDict()) == {"doc_id", "extra", "n_tokens", "ids", "decoded"}
    assert [(r.n_tokens, bytes(r.ids), r.decoded) for r in sorted(got, key=lambda r: r.doc_id)] == library(texts)


def test_full_bitmap_is_right_too(frame, monkeypatch):
    monkeypatch.setattr(bpe, "_shared_bitmap", lambda texts: texts.sparkSession.sparkContext.broadcast(np.full(bpe.BITMAP_BITS // 8, 255, np.uint8)))
    texts = sample()[:40]
    got = bpe.encode(frame([(None, t) for t in texts]), PATH).collect()
    assert sorted((r.n_tokens, bytes(r.ids), r.decoded) for r in got) == sorted(library(texts))


def test_chunks_depend_on_content():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh é") for _ in range(20_000))
    piece = next(words.pieces(pa.array([body, "zz" + body, "é" * 10_000])))
    own = []
    for k, ends in enumerate(bpe.chunk_ends(piece)):
        cuts = [int(piece.offsets[k]), *ends]
        own.append([piece.data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
        assert b"".join(own[-1]) == piece.text(k) and all(c.decode() and len(c) <= bpe.LONGEST + 3 for c in own[-1])
    assert len(set(own[0]) & set(own[1])) > 0.8 * len(own[0]) > 10


def test_empty_table(frame):
    assert bpe.encode(frame([]), PATH).count() == 0


def test_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(queries.QUERIES["op2_bpe"](spark, sf_dir).collect())
    want = [(r.doc_id, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
            for r, (n, ids, d) in zip(docs, library([r.text for r in docs]))]
    assert [tuple(r) for r in got] == want


def test_texts_are_copied_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from panelkit.llm import bpe as B

    texts = pa.array(["a b", None, "", "c" * 40, *[f"text {k}" for k in range(30)]])
    monkeypatch.setattr(B, "COPIED_ROWS", 7)
    for column in (texts, texts.slice(3, 20), texts.slice(0, 0)):
        found = {piece.first + k: piece.text(k).decode() for piece in B._pieces(column) for k in range(len(piece))}
        assert found == {k: t or "" for k, t in enumerate(column.to_pylist())}
