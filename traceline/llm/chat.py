"""Operator 4: transcripts to chat turns by a hidden Markov model.

A transcript is an ordered run of lines, some with a speaker marker.  Hidden states are (role, first
line or further line of a turn); a line shows its marker's role, its length, a question mark at its
end and whether it is blank.  Start, transition and feature probabilities are counted on conversations
whose roles are known (add-one smoothing), Viterbi finds the best states, and turns are rendered
canonically: the role's header, then the lines without markers.

A conversation of any length is decoded exactly.  Lines are sorted into ranges of about ``PART_ROWS``;
for a conversation that crosses range borders each range gives its best score from every entry state
to every exit state, a small chain over these fixes the states at the borders, and each range is then
decoded between its own.  So no task ever holds more than a range.

Defined cases: null ids are one conversation; a null turn number comes first; a null or empty text is
one blank line; equal rows keep any order among themselves; a transition across a range border is not
counted in training; without training rows all smoothed counts are equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import materialize

ROLES = ("system", "user", "assistant")
NAMES = {"system": "system context instructions", "user": "user human customer q", "assistant": "assistant ai bot model agent a"}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(rf"^\s*(?:[#*<\[|]+\s*)?({'|'.join(sorted(ROLE_OF, key=len, reverse=True))})\s*(?:[\]>|*]+\s*:?|:)\s*", re.IGNORECASE)
STATES = [(role, first) for role in ROLES for first in (True, False)]
#: Values of each feature: marker's role or none, length class, question mark, blank.
FEATURES = (len(ROLES) + 1, 6, 2, 2)
PART_ROWS = 65_536


def observe(line: str) -> tuple[int, ...]:
    found = MARKER.match(line)
    role = ROLES.index(ROLE_OF[found[1].lower()]) if found else len(ROLES)
    text = line[found.end():] if found else line
    length = min(5, max(0, len(text).bit_length() - 3))
    return role, length, int(text.rstrip().endswith("?")), int(not text.strip())


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    shows: list[np.ndarray]

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, shows: list[np.ndarray]) -> Model:
        first = np.array([f for _, f in STATES])
        possible = first[None, :] | (np.arange(len(STATES))[:, None] // 2 == np.arange(len(STATES))[None, :] // 2)
        with np.errstate(divide="ignore"):
            log = lambda n, ok: np.log((n + 1) * ok / ((n + 1) * ok).sum(axis=-1, keepdims=True))
            return cls(log(start, first), log(move, possible), [log(n, np.ones_like(n)) for n in shows])

    def emit(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observe(x) for x in lines]).reshape(-1, len(FEATURES))
        return sum(table[:, seen[:, i]].T for i, table in enumerate(self.shows))

    def transfer(self, lines: list[str], begins: bool) -> np.ndarray:
        """Best score from each state before the lines to each state of the last line."""
        emitted = self.emit(lines)
        best = np.tile(self.start + emitted[0], (len(STATES), 1)) if begins else self.move + emitted[0]
        for e in emitted[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + e
        return best

    def decode(self, lines: list[str], before: int | None = None, last: int | None = None) -> list[int]:
        """The best states after ``before`` (or at the start) that end in ``last`` (or anywhere)."""
        emitted = self.emit(lines)
        best, back = (self.start if before is None else self.move[before]) + emitted[0], []
        for e in emitted[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + e
        out = [int(best.argmax()) if last is None else last]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


# -- lines ---------------------------------------------------------------------------------------

def ranged_lines(transcripts: DataFrame, conv: Column, turn: Column, text: Column, role: Column, part_rows: int) -> DataFrame:
    """(conv, turn, at, line, role, first, part): every line, in ranges of the order (conv, turn, ...)."""
    rows = transcripts.select(conv.cast("bigint").alias("conv"), turn.cast("bigint").alias("turn"), role.cast("string").alias("role"),
                              F.coalesce(text, F.lit("")).alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "chat-rows")
    lines = rows.select("conv", "turn", "role", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = materialize(lines.withColumn("first", F.col("at") == 0), "chat-lines")
    order = ["conv", "turn", "row", "at"]  # unique, so no value is too frequent for a range
    n = max(1, -(-lines.count() // part_rows))
    return materialize(lines.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "chat-ranges")


def _exact(lines: DataFrame) -> DataFrame:
    """Nulls of ``conv`` and ``turn`` as flags, as pandas would make floats of all numbers beside them."""
    for c in ("conv", "turn"):
        lines = lines.withColumn(f"has_{c}", F.col(c).isNotNull()).withColumn(c, F.coalesce(c, F.lit(0)))
    return lines


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["has_conv", "conv", "has_turn", "turn", "row", "at"], ignore_index=True)


def _runs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, run in pdf.groupby(["has_conv", "conv"], sort=False):
        yield run


def fit(lines: DataFrame, known: Column) -> Model:
    """Counts over the lines for which ``known`` holds and whose role is one of ROLES."""
    sizes = [len(STATES), len(STATES) ** 2, *[len(STATES) * n for n in FEATURES]]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [np.zeros(n, np.int64) for n in sizes]
        for run in _runs(_sorted(pdf)):
            states = [2 * ROLES.index(r) + (not f) if r in ROLES else -1 for r, f in zip(run["role"], run["first"])]
            for i, (state, line) in enumerate(zip(states, run["line"])):
                if state < 0:
                    continue
                if i:
                    if states[i - 1] >= 0:
                        total[1][states[i - 1] * len(STATES) + state] += 1
                elif state % 2 == 0:
                    total[0][state] += 1
                for table, n, value in zip(total[2:], FEATURES, observe(line)):
                    table[state * n + value] += 1
        return pd.DataFrame({"counts": [np.concatenate(total)]})

    parts = _exact(lines.filter(known)).groupBy("part").applyInPandas(count, "counts array<bigint>")
    summed = parts.select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # one row for each count
    flat = np.zeros(sum(sizes))
    for r in summed:
        flat[r.i] = r.n
    start, move, *shows = np.split(flat, np.cumsum(sizes)[:-1])
    k = len(STATES)
    return Model.of_counts(start, move.reshape(k, k), [x.reshape(k, n) for x, n in zip(shows, FEATURES)])


def _borders(lines: DataFrame, model: Model) -> DataFrame:
    """(conv, part, before, last): the states around each range of a conversation in several ranges."""
    parts = lines.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    some = materialize(parts, "chat-cut").withColumnRenamed("conv", "c")  # at most one for each border
    cut = lines.join(some, lines["conv"].eqNullSafe(some["c"]), "inner").drop("c", "high")

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        begins = bool(pdf["part"].iloc[0] == pdf["low"].iloc[0])
        best = model.transfer(pdf["line"].tolist(), begins)
        conv = pdf["conv"].iloc[:1] if pdf["has_conv"].iloc[0] else pd.Series([None], dtype="Int64")
        return pd.DataFrame({"conv": conv, "part": pdf["part"].iloc[:1], "best": [best.ravel()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        ways = [np.array(x).reshape(len(STATES), len(STATES)) for x in pdf["best"]]
        best, back = ways[0][0], []
        for way in ways[1:]:
            both = best[:, None] + way
            back.append(both.argmax(axis=0))
            best = both.max(axis=0)
        last = [int(best.argmax())]
        for step in reversed(back):
            last.append(int(step[last[-1]]))
        last.reverse()
        return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "before": [-1, *last[:-1]], "last": last})

    matrices = _exact(cut).groupBy("has_conv", "conv", "part").applyInPandas(transfer, "conv bigint, part int, best array<double>")
    return matrices.groupBy("conv").applyInPandas(chain, "conv bigint, part int, before int, last int")


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conv, turn, row, at, role, begins, text, rendered): a row for each turn, and for each range that
    a turn goes on in; ``begins`` is false for those."""
    borders = materialize(_borders(lines, model), "chat-borders").select(F.col("conv").alias("c"), F.col("part").alias("p"), "before", "last")
    given = lines.join(borders, lines["conv"].eqNullSafe(borders["c"]) & (lines["part"] == borders["p"]), "left").drop("c", "p")

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run in _runs(_sorted(pdf)):
            before, last = run["before"].iloc[0], run["last"].iloc[0]
            states = model.decode(run["line"].tolist(), None if pd.isna(before) or before < 0 else int(before), None if pd.isna(last) else int(last))
            open_turn = None
            fields = ["has_conv", "conv", "has_turn", "turn", "row", "at", "line"]
            for (has_conv, conv, has_turn, turn, row, at, line), state in zip(run[fields].itertuples(index=False, name=None), states):
                conv, turn = conv if has_conv else None, turn if has_turn else None
                role, first = STATES[state]
                text = MARKER.sub("", line, count=1) if first else line
                if first or open_turn is None:
                    open_turn = [conv, turn, row, at, role, first, [text]]
                    out.append(open_turn)
                else:
                    open_turn[6].append(text)
        rows = []
        for conv, turn, row, at, role, begins, texts in out:
            text = "\n".join(texts)
            rows.append((conv, turn, row, at, role, begins, text, (f"<|{role}|>\n" if begins else "") + text + "\n"))
        frame = pd.DataFrame(rows, columns=["conv", "turn", "row", "at", "role", "begins", "text", "rendered"])
        for c in ("conv", "turn"):
            frame[c] = pd.array([r[0 if c == "conv" else 1] for r in rows], "Int64")
        for c in ("role", "text", "rendered"):
            frame[c] = frame[c].astype(object)
        return frame

    return _exact(given).groupBy("part").applyInPandas(
        decode, "conv bigint, turn bigint, row bigint, at int, role string, begins boolean, text string, rendered string")


# -- transcripts of known conversations ------------------------------------------------------------

def with_markers(conversations: DataFrame, drop_one_in: int = 3) -> DataFrame:
    """The conversations as transcripts: each in one of four marker styles, some turns without a marker."""
    style = F.abs(F.xxhash64("conv_id")) % 4
    name = F.initcap("role")
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n"))) \
        .when(style == 2, F.concat(F.lit("["), F.col("role"), F.lit("] "))) \
        .otherwise(F.concat(F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("Context"), F.lit(": ")))
    dropped = F.abs(F.xxhash64("conv_id", "turn", "text")) % drop_one_in == 0
    return conversations.withColumn("text", F.concat(F.when(dropped, F.lit("")).otherwise(F.coalesce(mark, F.lit(""))), F.coalesce("text", F.lit(""))))


def held_out(conv: Column) -> Column:
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 4 == 2, F.lit(False))
