import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts():
    r = random.Random(5)
    out = ["", " ", "\n", "  a  b ", "a\n b", " lead", "trail ", "x" * 3000, "日本語" * 200, "<|endoftext|> a", "🎉🎉 ok", "a \x1c b", "a\x1c b", "a \x85b", "é é", "it's we'll I'D", "​x​ y", "a  b", "\r\n\r\n x"]
    out += ["".join(r.choice(" ab\n\t'sé12日!  　") for _ in range(r.randint(0, 60))) for _ in range(500)]
    return out


def test_same_ids_as_the_public_tokenizer(public):
    data = texts() + [None]
    e = bpe.Encoder(bpe.load_ranks(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"))
    for _ in range(2):  # the second time from the memo
        at, ids = e.encode_batch(data)
        for i, t in enumerate(data):
            assert ids[at[i] : at[i + 1]].tolist() == public.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert e.encode_batch([])[0].tolist() == [0] and e.encode_batch([None, ""])[0].tolist() == [0, 0, 0]


def test_tree_against_plain_minimum():
    r = random.Random(3)
    ranks = [r.randint(0, 9) for _ in range(37)]
    tree = bpe.PairTree(ranks[:])
    for _ in range(300):
        least = min(ranks)
        assert tree.least() == (least, ranks.index(least))
        k = r.randrange(37)
        ranks[k] = r.randint(0, 9)
        tree.update(k, ranks[k])


def test_table(spark, public):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "hello world", "x"), (4, "word " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a clashing column
    got = bpe.encode_texts(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got)[:3] == [(1, 0), (2, 0), (2, 0)]
    assert {r.doc_id: r.ids for r in got}[4] == public.encode("word " * 20000, add_special_tokens=False).ids
    assert bpe.encode_texts(df.where("false"), "doc_id", "text").collect() == []
    assert bpe.encode_texts(df.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text").schema["doc_id"].dataType.simpleString() == "string"


def test_round_trip():
    ranks = bpe.load_ranks(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    back = {v: k for k, v in ranks.items()}
    e = bpe.Encoder(ranks)
    data = texts()
    at, ids = e.encode_batch(data)
    assert all(b"".join(back[int(x)] for x in ids[at[i] : at[i + 1]]).decode() == t for i, t in enumerate(data))
    assert ids.dtype == np.int32


def test_parts_cover_all_texts(monkeypatch):
    monkeypatch.setattr(bpe, "PART_ROWS", 3)
    monkeypatch.setattr(bpe, "PART_LETTERS", 10)
    for data in ([], [None], ["a"] * 7, ["x" * 50, "", None, "y" * 9, "zz", "z"], ["x" * 50, "x" * 50]):
        parts = list(bpe._parts(data))
        assert [k for a, b in parts for k in range(a, b)] == list(range(len(data))) and all(0 < b - a <= 3 for a, b in parts)
        assert all(b - a == 1 or sum(len(t or "") for t in data[a:b]) <= 10 for a, b in parts)
