"""Operator 2: substring deduplication by sliding spans of sentences.

A text is cut into sentences, and these after every word whose hash is the least of ``WINDOW``
consecutive words with it.  Whether a cut follows a word depends on the ``WINDOW - 1`` words on either
side alone, wherever the passage stands, and no unit has more than ``WINDOW`` words.  A span is the
shortest run of consecutive units from a given one that has at least ``SPAN`` units and ``MIN_WORDS``
words, and is hashed over its words.  In a passage of 50 words the cuts after words 7 to 44 are its own;
one is among words 7 to 13, and the run behind it ends by word 44, so every such passage holds a span.
All spans are joined globally on their hashes: the first document that holds a span keeps it, and in
every later one the sentences that it covers are removed, as are those of its further places inside
one document.

Only pairs of a document and a different span are shuffled; the counts per span combine before the
shuffle, and what a document loses is a list of its own spans.

Defined cases: a null text stays null; an empty one stays; documents are ordered by id; rows with null
ids come last, in any order, and are a document each; rows that share an id count as one document, whose
rows do not deduplicate each other.  A text that loses everything becomes empty.  The input's columns are kept in ``row``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import keyed, materialize

SPAN, MIN_WORDS, WINDOW = 3, 25, 7
#: A word up to the stops that follow it, and the white space behind.
WORD = re.compile(r"([^\s.!?]+[.!?]*|[.!?]+)(\s*)")
LEADING = re.compile(r"\s*")
STOPS = (".", "!", "?")


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _cuts(words: list[str]) -> np.ndarray:
    """Whether a cut follows each word: if its hash is the least of ``WINDOW`` consecutive words with it."""
    hashes = np.fromiter(map(_word_hash, words), np.uint32, len(words))
    window = min(WINDOW, len(words))
    starts = len(words) - window + 1
    least = hashes[:starts].copy()
    for k in range(1, window):
        np.minimum(least, hashes[k:k + starts], out=least)
    top = np.zeros(len(words), np.uint32)
    for k in range(window):
        np.maximum(top[k:k + starts], least, out=top[k:k + starts])
    return hashes == top


def _goes_on(gap: str, stopped: bool, following: str) -> bool:
    """Whether a sentence's end goes on behind ``gap``: line feeds alone stand between it and further stops."""
    tail = gap if stopped else gap[gap.index("\n"):]
    return following.startswith(STOPS) and tail.strip("\n") == ""


class Text:
    """The words of a text in lower case and its units; a unit ends with a sentence or at a cut."""

    def __init__(self, text: str):
        lead = LEADING.match(text).end()
        found = WORD.findall(text, lead)
        self.lead, self.found = text[:lead], found
        self.words = [w.lower() for w, _ in found]
        ends = np.zeros(len(found), bool)
        if found:
            ends |= _cuts(self.words)
            for k in [k for k, (word, gap) in enumerate(found) if word[-1] in ".!?" or (gap != " " and "\n" in gap)]:
                word, gap = found[k]
                ends[k] |= not (gap and k + 1 < len(found) and _goes_on(gap, word[-1] in ".!?", found[k + 1][0]))
            ends[-1] = True
        #: First word of each unit, and the number of words behind the last one.
        self.borders = np.concatenate(([0], np.flatnonzero(ends) + 1))
        #: White space that holds a line feed is a unit of its own at the beginning of a text.
        self.alone = int(bool(lead) and (not found or ("\n" in self.lead and not _goes_on(self.lead, False, found[0][0]))))

    @property
    def n_units(self) -> int:
        return self.alone + len(self.borders) - 1

    def units(self) -> list[str]:
        borders = self.borders.tolist()
        out = ["".join([w + gap for w, gap in self.found[a:b]]) for a, b in zip(borders, borders[1:])]
        if self.alone:
            return [self.lead, *out]
        return [self.lead + out[0], *out[1:]] if out else out

    def spans(self, span: int, min_words: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Hashes, first units and units behind the last; only words count, not the cuts between units."""
        borders = self.borders
        starts = borders[:-1]
        stops = np.maximum(np.searchsorted(borders, starts + min_words), np.arange(len(starts)) + span)
        first = np.flatnonzero(stops < len(borders))
        if not len(first):
            return [], first, first
        stops = stops[first]
        encoded = [w.encode() for w in self.words]
        at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in encoded])))
        joined = b" ".join(encoded)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b]) - (1 << 63) for a, b in zip(at[starts[first]].tolist(), (at[borders[stops]] - 1).tolist())]
        return hashes, first + self.alone, stops + self.alone


def sentences(text: str) -> list[str]:
    """Units whose concatenation is the text."""
    return Text(text).units()


def spans(text: str, span: int, min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first unit, unit behind the last); units without words belong to no span."""
    return [(h, a, b) for h, a, b in zip(*Text(text).spans(span, min_words))]


def removed(text: Text, later: set[int], span: int, min_words: int) -> set[int]:
    """Units covered by spans of ``later`` or by further places of a span."""
    gone: set[int] = set()
    seen: set[int] = set()
    for h, start, stop in zip(*text.spans(span, min_words)):
        if h in later or h in seen:
            gone.update(range(start, stop))
        seen.add(h)
    return gone


def _emit(span: int, min_words: int):
    """Rows (key, numbered, h) for the different spans of a text, and one without ``h`` that tells its ``units`` if no span
    of it stands twice: such a text loses nothing by itself and need not be cut up again unless an earlier one holds a span."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, numbered, hashes, units = [], [], [], []
            for key, is_number, text in zip(pdf["key"], pdf["numbered"], pdf["text"]):
                cut_up = Text(text)
                places = cut_up.spans(span, min_words)[0]
                found = set(places)
                hashes += [None, *found]
                units += [cut_up.n_units if len(found) == len(places) else None, *[None] * len(found)]
                keys += [key] * (len(found) + 1)
                numbered += [is_number] * (len(found) + 1)
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "numbered": pd.Series(numbered, dtype="bool"),
                                "h": pd.Series(hashes, dtype="Int64"), "units": pd.Series(units, dtype="Int64")})

    return emit


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_sentences, n_removed) for every row of ``docs``."""
    given = keyed(docs, id_col, "spans-without-id").select(
        "row", F.coalesce("id", "number").alias("key"), F.col("number").isNotNull().alias("numbered"))
    text = F.col("row").getField(text_col)
    held = given.filter(text.isNotNull()).select("key", "numbered", text.alias("text")) \
        .mapInPandas(_emit(span, min_words), "key bigint, numbered boolean, h bigint, units bigint")
    held = materialize(held, "spans")  # seventeen bytes for each span
    # Rows that share an id are not told apart here, so they are cut up again.
    whole = held.filter("h is null").groupBy("key", "numbered").agg(F.count(F.lit(1)).alias("rows"), F.max("units").alias("units")) \
        .filter("rows = 1 and units is not null").drop("rows")
    held = held.filter("h is not null").drop("units")
    of_id, of_number = (F.when(c, F.col("key")) for c in (~F.col("numbered"), F.col("numbered")))
    repeated = held.groupBy("h").agg(F.min(of_id).alias("first"), F.max(of_id).alias("last"),
                                     F.min(of_number).alias("first_number"), F.max(of_number).alias("last_number"))
    repeated = repeated.filter("first < last or first_number < last_number or (first is not null and first_number is not null)")
    repeated = materialize(repeated.select("h", F.coalesce("first", "first_number").alias("first_key"),
                                           F.col("first").isNull().alias("first_numbered")), "spans-repeated")
    later = held.join(repeated, "h").filter("key <> first_key or numbered <> first_numbered")
    later = materialize(later.groupBy("key", "numbered").agg(F.collect_set("h").alias("later")), "spans-later")

    @F.pandas_udf("text string, n_sentences bigint, n_removed bigint")
    def cut(texts: pd.Series, lists: pd.Series, units: pd.Series) -> pd.DataFrame:
        out = []
        for t, found, n in zip(texts, lists, units):
            if found is None and t is not None and not pd.isna(n):  # a null text may share its id
                out.append((t, int(n), 0))
                continue
            cut_up = Text(t or "")
            gone = removed(cut_up, set() if found is None else set(found.tolist()), span, min_words)
            out.append((t if not gone else "".join(u for i, u in enumerate(cut_up.units()) if i not in gone), cut_up.n_units, len(gone)))
        frame = pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])
        frame["text"] = frame["text"].astype(object)
        return frame

    facts = whole.join(later, ["key", "numbered"], "full")
    done = given.join(facts, ["key", "numbered"], "left").select(
        "row", cut(F.col("row").getField(text_col), "later", "units").alias("cut"))
    return done.select("row", "cut.text", "cut.n_sentences", "cut.n_removed")
