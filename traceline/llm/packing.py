"""Operator 5: harmonic packing of tokenized documents.

Piece lengths fall into the classes capacity, capacity/2, capacity/4, ..., 1.  A bin of the class
capacity/k takes exactly k pieces and is then full to the last token, so a piece's bin and offset
follow from its number in its class alone: workers number their pieces independently, and a small
table with one row for each partition and class shifts the numbers.  A document is cut into as many
whole sequences as it fills, and its rest at the binary digits of its length, largest piece first.
The last, incomplete bin of a class is split at the binary digits of its count, which makes
sequences whose lengths are powers of two and need no padding; nothing is padded at all.

Whole texts are tokenized.  The tokenizer treats what white space separates independently, so each
stretch between spaces and line feeds is encoded once for a batch and remembered by the worker, in a
memory of bounded size.

Defined cases: a null or empty text has only the end token; a null id stays null; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.llm.common import materialize

CAPACITY, END = 4096, 2
REMEMBERED, LONGEST_REMEMBERED, TOGETHER, CHARACTERS_AT_ONCE, PUNCTUATION = 250_000, 64, 256, 1 << 22, ".,!?;:"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    New words are encoded many at a time.  A word of letters alone is a single unit of the tokenizer,
    whose last token carries the mark of a word's end, so the ids of several such words are told apart
    by it; everything else is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the workers side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, at in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends[at] = token.endswith(suffix)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups = [words[at:at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                data = ids.tobytes()
                for word, start, stop in zip(group, [0, *stops[:-1].tolist()], stops.tolist()):
                    out[word] = data[4 * start:4 * stop]
            else:
                out.update(zip(group, (x.tobytes() for x in self._encode(group))))
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of stretches without spaces: letters, then perhaps common punctuation, or anything."""
        split, words, others = {}, set(), []
        for stretch in new:
            word = stretch.rstrip(PUNCTUATION)
            low = word.lower()
            if low.isalpha() and "Σ" not in word and len(low) <= LONGEST_REMEMBERED:  # sigma's lower case depends on its place
                split[stretch] = low, stretch[len(word):]
                words.add(low)
            else:
                others.append(stretch)
        known = self._encode_words(list(words))
        tails = list({tail for _, tail in split.values() if tail})
        tail_ids = dict(zip(tails, (x.tobytes() for x in self._encode(tails))), **{"": b""})
        found = {stretch: known[low] + tail_ids[tail] for stretch, (low, tail) in split.items()}
        found.update(zip(others, (x.tobytes() for x in self._encode(others))))
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for word in {w for words in split for w in words} - young.keys():
            if word in old:
                young[word] = old[word]
            else:
                new.append(word)
        young.update(self._learn(new))
        out = [b"".join([young[w] for w in words]) for words in split]
        for word in new:
            if len(word) > LONGEST_REMEMBERED:
                del young[word]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of the texts with at most ``CHARACTERS_AT_ONCE`` characters, or one text each."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size > CHARACTERS_AT_ONCE and at > start:
            yield texts[start:at]
            start, size = at, len(text or "")
    if start < len(texts):
        yield texts[start:]


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of the pieces: whole sequences, then the binary digits of the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pieces(path: str, capacity: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * capacity.bit_length()
        worker = TaskContext.get().partitionId()
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for who, encoded in enumerate(x for some in together(texts) for x in encoder(path)(some)):
                encoded += last
                view, start, total = memoryview(encoded), 0, len(encoded) // 4
                for length in cuts(total, capacity):
                    kind = length.bit_length() - 1
                    rows.append((who, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), total, kind, counts[kind]))
                    counts[kind] += 1
                    start += length
            if rows:
                who, *columns, kinds, numbers = zip(*rows)
                ids = batch.column(0).take(pa.array(who))  # not by way of floats, whatever nulls stand beside them
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(kinds, pa.int32()), pa.array(numbers, pa.int64()),
                     pa.array([worker] * len(who), pa.int32())],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "kind", "number", "worker"])

    return cut


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    pieces = materialize(given.mapInArrow(
        _pieces(tokenizer, capacity, end),
        "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, kind int, number bigint, worker int"), "pieces")

    # One row for each worker and class, then one for each class.
    counts = pieces.groupBy("worker", "kind").agg(F.count(F.lit(1)).alias("n"))
    kind = Window.partitionBy("kind")
    counts = counts.select("worker", "kind", F.sum("n").over(kind).alias("total"),
                           F.coalesce(F.sum("n").over(kind.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = counts.withColumn("per_bin", F.expr(f"shiftright({capacity}L, kind)")) \
        .withColumn("full", F.expr("total div per_bin")).withColumn("left", F.expr("total % per_bin"))
    bins = counts.groupBy("kind").agg(F.first(F.col("full") + F.bit_count("left")).alias("bins"))
    base = bins.select("kind", F.coalesce(F.sum("bins").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    counts = materialize(counts.join(base, "kind"), "piece-counts")

    placed = pieces.join(counts, ["worker", "kind"]).withColumn("at", F.col("before") + F.col("number")) \
        .withColumn("over", F.col("at") - F.col("full") * F.col("per_bin"))
    # Blocks of the incomplete bin: block b ends at the digits of the count from b up.
    block = F.lit(0)
    for b in range(capacity.bit_length()):
        ends = F.expr(f"shiftleft(shiftright(left, {b}), {b})")
        block = F.when((F.expr(f"shiftright(left, {b}) & 1") == 1) & (F.col("over") < ends), b).otherwise(block)
    placed = placed.withColumn("block", block)
    whole = F.col("over") < 0
    above = F.expr("shiftright(left, block + 1)")
    return placed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.when(whole, F.expr("at div per_bin")).otherwise(F.col("full") + F.bit_count(above))).cast("bigint").alias("sequence_id"),
        (F.col("length") * F.when(whole, F.expr("at % per_bin")).otherwise(F.col("over") - F.expr("shiftleft(shiftright(left, block + 1), block + 1)")))
        .cast("bigint").alias("offset"))
