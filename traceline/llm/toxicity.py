"""Operator 9: toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses, and five small transducers read the words of a clause that may matter:

- *insult*: terminals learned from labels, whole words or word beginnings (so that endings unseen in
  training match too);
- *threat*: verbs of harm, which count only with a target in the clause;
- *target*: second and third person forms;
- *negation*: a negating word turns the following ``NEGATION_REACH`` words;
- *reported speech*: a verb of saying turns the rest of the clause.

Their composition reads a clause once and outputs, for each insult or threat, the path it was reached
by; a text's score is a logistic function of the counts of these paths.  The weights are fitted to
labels, around a prior that discounts negated and reported paths, so matched clauses count and not
isolated words.

Learning uses at most ``fit_rows`` labelled rows of each class, those with the least hash of the id,
and never a held-out one.  Near copies share one unit of weight, so that words peculiar to a much copied
text do not pass for insults.  Every term that separates the classes clearly (``MIN_GAIN``, ``MIN_SHARE``,
``MIN_RATIO``) is kept, and paths are counted without a limit.  Everything sent to the driver comes from
that sample alone.  Scoring reads every whole text once and needs no shuffle.

Defined cases: a null or empty text scores like a text without any match; a null id is not held out
and has no label; rows with null labels are ignored; an id labelled twice counts as toxic if it is so
once; without labels of both classes the prior alone scores.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.llm.common import materialize

FIT_ROWS = 15_000
MIN_GAIN, MIN_SHARE, MIN_RATIO = 25.0, 0.003, 5.0
PREFIXES, NEGATION_REACH, LONG_WORD, THRESHOLD = (3, 4, 5, 6, 7, 8), 3, 8, 0.3

WORD, CLAUSE_END = re.compile(r"\w+"), re.compile(r"[.!?;\n]+")
THREATS = frozenset("kill hurt shoot stab beat punch destroy töten schlagen erschießen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours u he she they him her them du dich dir ihr euch sie tu te toi vous ils elle usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never nobody n't isn't nicht kein keine nie pas jamais aucun nunca ningún tampoco".split())
REPORTS = frozenset("said says say told claimed wrote writes quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split())
PATHS = ("insult", "different", "targeted", "negated", "reported", "threat")
PRIOR = np.array([2.0, 1.0, 0.5, -0.5, -0.5, 1.5])
PRIOR_BASE = -4.0


@dataclass
class Grammar:
    terms: frozenset[str] = frozenset()  # a beginning ends in "*"
    base: float = PRIOR_BASE
    weights: tuple[float, ...] = tuple(PRIOR)
    _finder: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.terms, self.base, self.weights

    def __setstate__(self, state):
        self.terms, self.base, self.weights = state
        self._finder = None

    def _find(self, text: str) -> Iterator[int]:
        """Where a word stands that an insult or threat may begin with; never inside a word."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for term in {*self.terms, *THREATS}:
                self._finder.add_word(term.rstrip("*"), len(term.rstrip("*")))
            self._finder.make_automaton()
        for end, length in self._finder.iter(text):
            at = end - length + 1
            if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_"):
                yield at

    def terminal(self, word: str) -> str | None:
        if word in self.terms:
            return word
        return next((word[:n] for n in PREFIXES if word[:n] + "*" in self.terms), None)

    def read(self, text: str | None) -> tuple[int, ...]:
        """Counts of PATHS."""
        text = (text or "").lower()
        counts, seen, done = dict.fromkeys(PATHS, 0), set(), -1
        for at in self._find(text):
            if at < done:
                continue  # in a clause that has been read
            start = 0
            for ends in CLAUSE_END.finditer(text, max(0, done), at):
                start = ends.end()
            start = max(start, 0 if done < 0 else done)
            stop = CLAUSE_END.search(text, at)
            done = stop.start() if stop else len(text)
            self._clause(WORD.findall(text[start:done]), counts, seen)
            done = max(done, at + 1)
        counts["different"] = len(seen)
        return tuple(counts[p] for p in PATHS)

    def _clause(self, words: list[str], counts: dict[str, int], seen: set[str]) -> None:
        """One run of the composed transducers."""
        target = any(w in TARGETS for w in words)
        negated, reported = 0, False
        for word in words:
            if term := self.terminal(word):
                counts["insult"] += 1
                seen.add(term)
                counts["targeted"] += target
                counts["negated"] += negated > 0
                counts["reported"] += reported
            elif word in THREATS and target and not negated:
                counts["threat"] += 1
            negated = NEGATION_REACH if word in NEGATIONS else max(0, negated - 1)
            reported = reported or word in REPORTS

    def score(self, paths: tuple[int, ...]) -> float:
        z = self.base + float(np.log1p(np.array(paths)) @ np.array(self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# -- learning ----------------------------------------------------------------------------------

def _terms_of(text: str) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _likeness(text: str | None) -> int:
    """The two least hashes of long words, mostly shared by near copies; of the text if it has no two."""
    least = nsmallest(2, {zlib.crc32(w.encode()) for w in WORD.findall((text or "").lower()) if len(w) >= LONG_WORD})
    return least[0] << 31 ^ least[1] if len(least) == 2 else -1 - zlib.crc32((text or "").encode())


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = (defaultdict(float), defaultdict(float))

    def flush():
        terms = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"term": pd.Series(terms, dtype=object), "neg": [counts[0].get(t, 0.0) for t in terms], "pos": [counts[1].get(t, 0.0) for t in terms]})
        counts[0].clear()
        counts[1].clear()
        return out

    for pdf in batches:
        for text, toxic, weight in zip(pdf["text"], pdf["toxic"], pdf["weight"]):
            count = counts[toxic]
            for term in _terms_of(text):
                count[term] += weight
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()


def _gain(pos: Column, neg: Column, n_pos: float, n_neg: float) -> Column:
    """Twice the log-likelihood gained by two rates over one."""
    def part(a: Column, n: float) -> Column:
        rate, all_rate = a / n, (pos + neg) / (n_pos + n_neg)
        has = F.when(a > 0, a * F.ln(rate / all_rate)).otherwise(0.0)
        return has + F.when(a < n, (n - a) * F.ln((1 - rate) / (1 - all_rate))).otherwise(0.0)

    return 2 * (part(pos, n_pos) + part(neg, n_neg))


def _choose(found: list) -> frozenset[str]:
    """Best first; of terms that begin alike only the best, of equals the longest and most exact."""
    chosen: list[str] = []
    stems: set[str] = set()
    beginnings: set[str] = set()
    for row in sorted(found, key=lambda r: (-round(r.gain, 6), -len(r.term.rstrip("*")), r.term.endswith("*"), r.term)):
        stem = row.term.rstrip("*")
        own = {stem[:n] for n in range(1, len(stem) + 1)}
        if stem not in beginnings and not own & stems:
            chosen.append(row.term)
            stems.add(stem)
            beginnings |= own
    return frozenset(chosen)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Ridge regression around the prior, the base free, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    prior, ridge = np.concatenate(([PRIOR_BASE], PRIOR)), np.array([1e-3] + [1.0] * len(PRIOR))
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * (beta - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), beta[1:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS) -> Grammar:
    known = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = materialize(known, "toxic-labels")
    of_class = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if set(of_class) != {0, 1}:
        return Grammar()
    least = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for c in (0, 1)]
    sample = materialize(least[0].unionByName(least[1]), "toxic-sample")
    # At most 2 * fit_rows rows of an id and a label are broadcast.
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "toxic")
    @F.pandas_udf("bigint")
    def alike(texts: pd.Series) -> pd.Series:
        return pd.Series([_likeness(t) for t in texts], dtype="int64")

    likeness = Window.partitionBy("toxic", "likeness")
    train = materialize(train.withColumn("likeness", alike("text"))
                        .withColumn("weight", 1.0 / F.count(F.lit(1)).over(likeness)).drop("likeness"), "toxic-train")
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    if set(n) != {0, 1}:
        return Grammar()

    terms = train.mapInPandas(_count_terms, "term string, neg double, pos double").groupBy("term") \
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    strong = terms.filter((F.col("pos") >= max(2.5, MIN_SHARE * n[1])) & (F.col("pos") / n[1] >= MIN_RATIO * F.col("neg") / n[0])) \
        .withColumn("gain", _gain(F.col("pos"), F.col("neg"), n[1], n[0])).filter(F.col("gain") >= MIN_GAIN)
    grammar = Grammar(_choose(strong.collect()))

    @F.pandas_udf("array<int>")
    def paths(texts: pd.Series) -> pd.Series:
        return pd.Series([list(grammar.read(t)) for t in texts])

    # At most one vector for each of the 2 * fit_rows rows.
    vectors = train.select(paths("text").alias("x"), "toxic", "weight").groupBy("x", "toxic").agg(F.sum("weight").alias("n")).collect()
    x, y = np.log1p(np.array([r.x for r in vectors], float)), np.array([r.toxic for r in vectors], float)
    each = np.array([r.n * of_class[r.toxic] / n[r.toxic] for r in vectors])
    base, weights = _logistic(x, y, each * sum(n.values()) / each.sum())
    return Grammar(grammar.terms, base, tuple(weights))


# -- scoring -----------------------------------------------------------------------------------

def scorer(grammar: Grammar):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[tuple[int, ...], float] = {}
        out = []
        for text in texts:
            paths = grammar.read(text)
            if paths not in known:
                known[paths] = grammar.score(paths)
            out.append(known[paths])
        return pd.Series(out, dtype="float64")

    return score


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    return docs.filter(scorer(grammar)(F.col(text_col)) < threshold)
