"""Pieces against the tokenizer itself, and the layout of the sequences."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from traceline.llm.packing import cuts, pack
from traceline.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, kind string, worker int, total int"
TEXTS = [None, "", " ", "\n", "Hello  World\n\nagain", "don't it's we'll x'd", "a" * 300, "näive É\x1cb\x85c ́ x", "<|endoftext|> and <|startoftext|>x",
         "1234 ½ ☃☃ 漢字かな", "word " * 9000, "tab\tseparated \r\n lines", "Σ ΑΣ ς"] + [f"text number {i} of some words" for i in range(80)]


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pack(spark, capacity):
    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t, "k", 1, 2) for i, t in enumerate(TEXTS)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(5), path, capacity=capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0  # nothing is padded


def test_cuts():
    assert cuts(4096, 4096) == [4096] and cuts(1, 4096) == [1] and cuts(8197, 4096) == [4096, 4096, 4, 1]


def test_ties_nulls_and_empty(spark):
    path = tokenizer_file("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b", "k", 1, 2), (1, "a b", "k", 1, 2), (None, "c", "k", 1, 2)], SCHEMA)
    large = [2 ** 60 + 1, None, 2 ** 60 + 2, -(2 ** 60) - 1]
    ids = pack(spark.createDataFrame([(i, "a b", "k", 1, 2) for i in large], SCHEMA).coalesce(1), path).select("id").distinct().collect()
    assert {r.id for r in ids} == set(large)
    got = pack(df, path).collect()
    assert sorted((str(r.id), r.doc_tokens) for r in got) == [("1", 3)] * 4 + [("None", 2)]
    assert pack(df.limit(0), path).collect() == []
