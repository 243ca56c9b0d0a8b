"""Counts against the unigram tokenizer of an installed library with the same pieces and scores."""

import random

import pytest
from tokenizers import Tokenizer, models

from traceline.llm.queries import tokenizer_file
from traceline.llm.tokencount import MARK, Vocabulary, count_tokens, from_pieces


def reference(pieces, byte_fallback):
    extra = [(f"<0x{b:02X}>", -1e6) for b in range(256)] if byte_fallback else []
    return Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces, *extra], unk_id=0, byte_fallback=byte_fallback))


def expected(tokenizer, text):
    return len(tokenizer.encode(MARK + text.replace(" ", MARK), add_special_tokens=False).ids) if text else 0


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_small_vocabularies(byte_fallback):
    rng = random.Random(4)
    for round_ in range(60):
        pieces = {MARK: -3.0} if round_ % 2 else {}
        for _ in range(rng.randrange(1, 14)):
            pieces[rng.choice(["", MARK]) + "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4)))] = float(-rng.randrange(4))
        least = min(pieces.values())
        # the library takes the unknown's score from the least of all, so byte pieces must not be lower
        extra = [(f"<0x{b:02X}>", least) for b in range(256)] if byte_fallback else []
        tokenizer = Tokenizer(models.Unigram([("<unk>", least), *pieces.items(), *extra], unk_id=0, byte_fallback=byte_fallback))
        ours = Vocabulary(list(pieces.items()), byte_fallback)
        for _ in range(30):
            text = "".join(rng.choice("abcéx \n☃") for _ in range(rng.randrange(14)))
            assert ours.count(text) == expected(tokenizer, text), (pieces, text)


def test_given_vocabulary():
    ours = from_pieces(tokenizer_file("piece_bpe_32k.model"))
    least = min(s for _, s in ours.pieces)
    tokenizer = Tokenizer(models.Unigram([("<unk>", least), *ours.pieces, *[(f"<0x{b:02X}>", least) for b in range(256)]], unk_id=0, byte_fallback=True))
    for text in ["", "Hello world", "  two  spaces ", "naïve ☃ 漢字\n\nx\ty", "eréeux enanréoi émentment", "a" * 500, "word " * 3000, "🙂 ok"]:
        assert ours.count(text) == expected(tokenizer, text), text


def test_table(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    assert from_pieces(path).count("Hello") == 3
    df = spark.createDataFrame([(1, "Hello", 0), (1, "Hello", 0), (None, None, 0), (2, "", 0)], "doc_id bigint, text string, tokens int")
    assert sorted(((r.id, r.tokens) for r in count_tokens(df, path).collect()), key=str) == [(1, 3), (1, 3), (2, 0), (None, 0)]
    assert count_tokens(df.limit(0), path).collect() == []
