"""Span deduplication against a plain version, and planted passages."""

import random
import re
import zlib

import pandas as pd
import xxhash

from traceline.llm.spans import MIN_WORDS, SPAN, Text, _emit, dedup_spans, sentences, spans

SCHEMA = "doc_id bigint, text string, row string, rank int, h string, later int, cut int"


def plain(rows):
    first = {}
    key = lambda i, d: (d is None, i if d is None else d)
    for i, (doc, text) in enumerate(rows):
        for h, _, _ in spans(text or "", SPAN, MIN_WORDS):
            first[h] = min(first.get(h, key(i, doc)), key(i, doc))
    out = []
    for i, (doc, text) in enumerate(rows):
        units = sentences(text or "")
        gone, seen = set(), set()
        for h, start, stop in spans(text or "", SPAN, MIN_WORDS):
            gone |= set(range(start, stop)) if h in seen or first[h] < key(i, doc) else set()
            seen.add(h)
        out.append((doc, text if not gone else "".join(u for i, u in enumerate(units) if i not in gone), len(units), len(gone)))
    return sorted(out, key=str)


def run(spark, rows):
    got = dedup_spans(spark.createDataFrame([(*r, "a", 1, "b", 2, 3) for r in rows], SCHEMA)).collect()
    return sorted(((r.row.doc_id, r.text, r.n_sentences, r.n_removed) for r in got), key=str)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n)).capitalize() + rng.choice([".", "!", "?"])


def test_against_plain(spark):
    rng = random.Random(6)
    pool = [sentence(rng, rng.randrange(1, 30)) for _ in range(7)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else sentence(rng, 6) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (70, None), (71, "no end of a sentence"), (72, "\n\n")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_copies_without_ids(spark):
    rng = random.Random(12)
    text = " ".join(sentence(rng, 9) for _ in range(8))
    got = run(spark, [(None, text)] * 3)
    assert sorted(t == text for _, t, _, _ in got) == [False, False, True] and all(t == text or len(t) < len(text) / 5 for _, t, _, _ in got)
    largest = (1 << 63) - 1
    got = run(spark, [(None, text), (largest, text), (0, "other words"), (None, "no span")])
    assert {(d, t == text) for d, t, _, _ in got if t not in ("other words", "no span")} == {(None, False), (largest, True)}


def test_units_are_the_text():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Bc ", ".", "! ", "\n", " ", "é?", "word " * 30]) for _ in range(rng.randrange(20)))
        assert "".join(sentences(text)) == text


def plain_units(text):
    """Sentences by one pattern, these after every word whose checksum is least in a window of seven."""
    found = [(s, re.findall(r"\s*\S+\s*", s)) for s in re.findall(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+", text)]
    sums = [zlib.crc32(w.strip().lower().encode()) for _, words in found for w in words]
    windows = [sums[i:i + 7] for i in range(max(1, len(sums) - 6))]
    out, at = [], 0
    for sentence, words in found:
        unit = "" if words else sentence
        for k, word in enumerate(words):
            unit += word
            if k + 1 < len(words) and any(min(x) == sums[at] for x in windows[max(0, at - 6):at + 1]):
                out.append(unit)
                unit = ""
            at += 1
        out.append(unit)
    return out


def plain_spans(units):
    words = [(i, u.lower().split()) for i, u in enumerate(units)]
    words = [(i, w) for i, w in words if w]
    out = []
    for a in range(len(words)):
        for b in range(a + SPAN, len(words) + 1):
            run = [w for _, ws in words[a:b] for w in ws]
            if len(run) >= MIN_WORDS:
                out.append((xxhash.xxh64_intdigest(" ".join(run).encode()) - (1 << 63), words[a][0], words[b - 1][0] + 1))
                break
    return out


def test_units_and_spans_against_patterns():
    rng = random.Random(18)
    kinds = ["a", "Bc ", ".", "! ", "\n", " ", "é?", "?.", " \n", "x.y", "\t", "\u00a0", "word " * 9]
    for _ in range(5000):
        text = "".join(rng.choice(kinds) for _ in range(rng.randrange(25)))
        assert sentences(text) == plain_units(text), text
        assert spans(text, SPAN, MIN_WORDS) == plain_spans(plain_units(text)), text
        assert Text(text).n_units == len(plain_units(text))


def test_long_passages_go_from_later_documents_only(spark):
    rng = random.Random(9)
    passages = [" ".join(sentence(rng, 9) for _ in range(6)), sentence(rng, 90)]  # the second has no end inside
    own = [sentence(rng, 8) for _ in range(8)]
    rows = [(i, f"{own[i]} {own[i + 4]} {passages[i % 2]} {own[i]}") for i in range(4)]
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert got[0] == rows[0][1] and got[1] == rows[1][1]
    for i in (2, 3):
        left = got[i].split()
        assert left[:16] == rows[i][1].split()[:16] and len(left) < 24 + 26 and own[i] in got[i]


def test_every_passage_of_50_words_holds_a_span():
    rng = random.Random(10)
    found = lambda text: {h for h, _, _ in spans(text, SPAN, MIN_WORDS)}
    text = lambda n, kinds, ends: " ".join(f"w{rng.randrange(kinds)}" + rng.choice(ends) for _ in range(n))
    for k in range(3000):
        passage = text(50, rng.choice([2, 5, 5000]), rng.choice([[""], [""] * 12 + [".", "?"], [""] * 20 + ["!"]]))
        a, b = (f"{text(rng.randrange(60), 5000, [''] * 9 + ['.'])} {passage} {text(rng.randrange(60), 5000, [''])}" for _ in "ab")
        assert found(a) & found(b), (k, passage)


def test_texts_that_lose_nothing_are_not_cut_up_again(spark):
    plain = " ".join(f"w{i}." for i in range(60))
    twice = f"{plain} And then again. {plain}"
    (found,) = _emit(SPAN, MIN_WORDS)(iter([pd.DataFrame({"key": [1, 2], "numbered": [False] * 2, "text": [plain, twice]})]))
    told = found[found["h"].isna()].set_index("key")["units"]
    assert told[1] == 60 and pd.isna(told[2])
    docs = spark.createDataFrame([(1, plain.upper().replace("W", "x")), (1, None), (2, plain), (3, twice)], "doc_id long, text string")
    got = {(r.row.doc_id, r.row.text): (r.text, r.n_sentences, r.n_removed) for r in dedup_spans(docs).collect()}
    for text in (plain.upper().replace("W", "x"), plain):
        assert got[2 if text == plain else 1, text] == (text, 60, 0)
    assert got[1, None] == (None, 0, 0) and got[3, twice][2] > 60
