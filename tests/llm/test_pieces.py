"""Encoding by chunks against the library on whole texts."""

import hashlib
from random import Random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factmill.llm import pieces, queries
from factmill.llm.shared import text_slices

from .helpers import documents, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", " ", "▁", "the", "漢", "é", "\n", "\t", "\0", "<s>", "1", "🙂", "ḁ", "  ", "▁▁", "▁x", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoder():
    with open(PATH, "rb") as file:
        return pieces.Encoder(file.read())


def compare(encoder, library, texts):
    for part in text_slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])):
        ids, counts = encoder.encode(part.data, part.offsets)
        ends = np.cumsum(counts)
        want = library.encode([t or "" for t in part.rows.column(0).to_pylist()], add_bos=True, add_eos=True)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want
        assert encoder.decode(ids, np.concatenate(([0], ends))).to_pylist() == [library.decode(w) for w in want]


@pytest.mark.parametrize("stretch", [5, 17, 64, 1 << 20])
def test_texts(library, monkeypatch, stretch):
    monkeypatch.setattr(pieces, "SLICE_BYTES", stretch)
    r, e = Random(stretch), encoder()
    assert e.apart
    for _ in range(60):
        compare(e, library, ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 20))] + ["", None, " "])
    compare(e, library, ["x" * 3000, "Wort " * 2000, "a  b" * 1000, "▁" * 500])


def test_small_table_and_whole_texts(library, monkeypatch):
    """Neither a table that is always full nor a model taken as one whose pieces cross markers changes ids."""
    monkeypatch.setattr(pieces, "TABLE_BYTES", 200)
    r, e, whole = Random(1), encoder(), encoder()
    whole.apart = False
    for _ in range(20):
        texts = ["".join(r.choice(PARTS) for _ in range(30)) for _ in range(10)]
        compare(e, library, texts)
        compare(whole, library, texts)
    assert e.held <= 200


def test_decoding_any_ids(library):
    r, e = Random(3), encoder()
    for _ in range(500):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.choice([0, 1, 2, 3, 35, 230, 28705, 259, 287]) for _ in range(r.randint(0, 12))]
        assert e.decode(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist() == [library.decode(ids)]


def test_query(spark, library, tmp_path):
    r = Random(5)
    extra = [(20_000 + i, "".join(r.choice(PARTS) for _ in range(60)), None, None, None, None, None) for i in range(50)]
    docs, rows = documents(spark, 100, 3, extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(g) for g in queries.op13_sentencepiece(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_round_trip_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "Ein  Satz.\n", 1), (1, "Ein  Satz.\n", 1), (None, None, 2)], "doc_id long, text string, ids int").withColumn("_id", F.lit("clash"))
    encoded = pieces.encode(docs, PATH)
    assert encoded.count() == 3 and pieces.encode(empty(spark), PATH).count() == 0
    nulls = encoded.unionByName(spark.createDataFrame([(7, None)], "doc_id long, ids array<int>"))
    got = sorted(((g["doc_id"], g["text"]) for g in pieces.decode(nulls, PATH).collect()), key=str)
    assert got == sorted([(1, "Ein  Satz.\n"), (1, "Ein  Satz.\n"), (None, ""), (7, None)], key=str)
