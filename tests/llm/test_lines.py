"""Line deduplication against a plain version, and the alignment against its properties."""

import random

from traceline.llm.lines import align, common_blocks, dedup_lines

SCHEMA = "doc_id bigint, text string, row string, kept int, lines string, k1 int"


def long(line):
    return len(line.split()) >= 3


def plain(rows):
    """Texts that stay, by walking every document against the first holders of its lines."""
    norm = lambda t: [x.replace("\t", " ").replace("\r", " ").strip(" ") for x in t.split("\n")]
    texts = {}
    for doc, text in rows:
        if text:
            texts[text] = min(texts.get(text, 1 << 63), doc if doc is not None else (1 << 63) - 1)
    order = sorted(texts, key=lambda t: texts[t])
    first = {}
    for t in order:
        for line in norm(t):
            if long(line):
                first.setdefault(line, t)
    ids = {}
    code = lambda line: ids.setdefault(line, 2 * len(ids) + 2 + long(line)) if line else 0
    out, nameless = [], set()
    for doc, text in rows:
        if not text:
            out.append((doc, text))
            continue
        if (doc if doc is not None else (1 << 63) - 1) > texts[text] or (doc is None and text in nameless):
            out.append((doc, ""))
            continue
        if doc is None:
            nameless.add(text)
        lines, gone = norm(text), set()
        for partner in {first[x] for x in lines if long(x)} - {text}:
            gone |= set(common_blocks([code(x) for x in norm(partner)], [code(x) for x in lines]))
        out.append((doc, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows):
    got = dedup_lines(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)).collect()
    for r in got:
        assert r.n_lines == (0 if r.row.text is None else len(r.row.text.split("\n")))
        if r.text:
            assert r.n_lines - r.n_deleted == len(r.text.split("\n"))
    return sorted(((r.row.doc_id, r.text) for r in got), key=str)


def test_against_plain(spark):
    rng = random.Random(2)
    pool = [f"shared line number {i}" for i in range(25)] + ["ok", "", "two words"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {j}" for j in range(rng.randrange(1, 14)))) for i in range(70)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(20)] + [(200, None), (201, ""), (202, "\n"), (None, rows[3][1]), (None, "one more line\nonly here now")]
    rows += [(5, rows[5][1])]
    assert run(spark, rows) == plain(rows)


def test_no_shared_line_stays(spark):
    """Repeated lines and blocks in another order, by sets alone."""
    rng = random.Random(5)
    pool = [f"shared line number {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "ok", "", f"own line {i} {j}"]) for j in range(rng.randrange(1, 25)))) for i in range(60)]
    seen, want = set(), []
    for doc, text in rows:
        want.append((doc, [x for x in text.split("\n") if long(x) and x not in seen]))
        seen |= set(text.split("\n"))
    assert {doc: [x for x in text.split("\n") if long(x)] for doc, text in run(spark, rows)} == dict(want)


def test_blocks_repeated_and_moved():
    assert common_blocks([1, 3, 5, 7], [5, 7, 1, 3]) == [0, 1, 2, 3]
    assert common_blocks([1, 2, 3], [1, 9, 1, 2, 11, 2]) == [0, 2, 3]
    assert common_blocks([1, 1, 4, 1], [13, 4, 1, 15, 1, 4]) == [1, 2, 4, 5]
    assert common_blocks([1, 2], [2, 15, 2]) == []
    assert common_blocks([1] * 20_000, [9, 1] * 20_000) == list(range(1, 40_000, 2))


def test_passage_in_later_document(spark):
    passage = "first line of it\nok\nsecond line of it"
    rows = [(1, "a b c\n" + passage), (2, passage + "\nown words stay here"), (3, "nothing shared with any\nok")]
    assert run(spark, rows) == [(1, rows[0][1]), (2, "own words stay here"), (3, rows[2][1])]


def test_copies_without_ids(spark):
    text, other, largest = "a line of words\nanother line of words", "a line of words\nand one more line", (1 << 63) - 1
    assert run(spark, [(None, text)] * 3) == sorted([(None, text), (None, ""), (None, "")], key=str)
    assert run(spark, [(None, text), (largest, text)]) == sorted([(None, ""), (largest, text)], key=str)
    assert run(spark, [(None, text), (None, text), (4, other)]) == sorted([(None, "another line of words"), (None, ""), (4, other)], key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_alignment():
    assert align([1, 2, 3], [1, 9, 3]) == [(0, 0), (2, 2)]
    assert align([1, 2, 3, 4], [3, 4, 1, 2])  # crossing blocks: one of them
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in "ab")
        found = align(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))
    many = list(range(1, 40_001, 2))
    assert len(align(many, many[:10_000] + [7777777] + many[10_000:])) == len(many)


def test_long_text(spark):
    text = "\n".join(f"line {i} of many" for i in range(20_000))
    got = dict(run(spark, [(1, text), (2, text.replace("line 77 of", "line seventy-seven of"))]))
    assert got[2] == "line seventy-seven of many"
