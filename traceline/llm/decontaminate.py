"""Operator 10: benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words is one window).  Of
the word ``k``-grams inside a window the one with the least hash is its fingerprint; a document keeps
the same minimum of each of its own windows.  Equal windows have equal minima at the same offset, so
joining the two sides on the hash loses no window that occurs; each hit is then laid over the
document at its offset, extended to the whole window, and kept if every word is equal.

Documents are identified by two hashes of their text, so repeated rows and copies are one text.
The fingerprints of the benchmark meet those of the documents in an ordinary join: Spark broadcasts
them where they are small and shuffles where they are not.

Defined cases: a null or wordless text has no words and is never hit; a null or wordless item has no
windows; an item whose id is null can hit but is not listed; an id that several items share is
listed once; equal windows of several items list all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import lower_ascii, materialize, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words of a text whose A-Z are not yet in lower case.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 4
#: The low bits of a fingerprint hold its position; a text cannot have more words than that.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("bigint")


def _along(last: Column, at) -> Column:
    """``at(i)`` for i from 0 to ``last``; empty if ``last`` is negative."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def _grams(hashes: Column, size: int) -> Column:
    """For each position its ``size``-gram: hash above, position below."""
    return _along(F.size(hashes) - size, lambda i: F.xxhash64(F.lit(size), *[hashes[i + j] for j in range(size)])
                  .bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint")))


def _minima(grams: Column, window: int, gram: int) -> Column:
    """The least gram of each window, each once."""
    span = window - gram + 1
    return F.array_distinct(_along(F.size(grams) - span, lambda i: F.least(*[grams[i + j] for j in range(span)])))


def _hash_words(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    return df.select(*keep, words(text).alias("w")).select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, n: int, k: int) -> DataFrame:
    """(span, least, offset, wtext, items): each different window once, with its fingerprint."""
    texts = _hash_words(items, F.col(text_col), F.col(id_col).alias("item_id")).filter(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(n))
    cut = texts.select("item_id", span.alias("span"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - span + 1),
        lambda i: F.struct(F.slice("w", i, span).alias("w"), F.slice("h", i, span).alias("h")))).alias("_x")) \
        .select("item_id", "span", F.array_join("_x.w", " ").alias("wtext"), F.col("_x.h").alias("h"))
    rows = cut.groupBy("span", "wtext").agg(F.first("h").alias("h"), F.array_sort(F.collect_set("item_id")).alias("items"))
    least = F.when(F.col("span") == n, F.array_min(_grams(F.col("h"), k)))
    for m in range(1, n):  # an item shorter than a window: the whole of it is the gram
        least = least.when(F.col("span") == m, F.array_min(_grams(F.col("h"), m)))
    return rows.select("span", least.alias("least"), "wtext", "items") \
        .select("span", F.shiftright("least", PLACE_BITS).alias("gram"), F.col("least").bitwiseAND(F.lit(PLACE)).cast("int").alias("offset"),
                "wtext", "items")


def hit_texts(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(k1, k2, n_hit, items): the texts of ``docs`` in which a window occurs, the words inside
    occurrences, and the sorted array of item ids."""
    k = min(k, n)
    windows = materialize(benchmark_windows(items, item_col, item_text_col, n, k), "windows")
    # Windows of one passage mostly belong to the same items: such sets get one name.
    sets = materialize(windows.groupBy("items").agg(F.min(F.struct("span", "wtext")).alias("set")), "window-sets")
    prints = materialize(windows.join(sets, "items").select("span", "gram", "offset", "wtext", "set"), "window-prints")

    text = F.col(text_col)
    hashed = _hash_words(docs, text, *text_key(text)).select("k1", "k2", "h")
    # The grams are a column of their own: inside the function of the minima they would be made anew for each window.
    grams = hashed.select("k1", "k2", _grams(F.col("h"), k).alias("g"))
    found = grams.select("k1", "k2", F.lit(n).alias("span"), F.explode(_minima(F.col("g"), n, k)).alias("p"))
    shorter = [r.span for r in prints.filter(F.col("span") < n).select("span").distinct().collect()]  # fewer than n rows
    for m in shorter:
        found = found.unionByName(hashed.select("k1", "k2", F.lit(m).alias("span"), F.explode(_grams(F.col("h"), m)).alias("p")))
    hits = found.select("k1", "k2", "span", F.shiftright("p", PLACE_BITS).alias("gram"),
                        F.col("p").bitwiseAND(F.lit(PLACE)).cast("int").alias("at")) \
        .join(prints, ["span", "gram"]) \
        .select("k1", "k2", F.struct((F.col("at") - F.col("offset")).alias("start"), "span", "wtext", "set").alias("hit")) \
        .filter("hit.start >= 0")
    laid = materialize(hits.groupBy("k1", "k2").agg(F.collect_set("hit").alias("hits")), "window-hits")

    texts = docs.select(*text_key(text), text.alias("_text")).join(laid, ["k1", "k2"])
    # Each of two uses keeps the words a column of their own, made once for a text and not for a hit; nor may
    # the filter on what is left stand here, as it would be pushed below with the words inside it.
    kept = texts.select("k1", "k2", "hits", words(F.col("_text")).alias("w")).select(
        "k1", "k2", F.filter("hits", lambda h: (h.start + h.span <= F.size("w"))
                             & (F.array_join(F.slice(F.col("w"), h.start + 1, h.span), " ") == h.wtext)).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.start, h.start + h.span - 1))))
    texts = materialize(kept.select("k1", "k2", F.size(covered).cast("bigint").alias("n_hit"),
                                    F.array_distinct(F.transform("hits", lambda h: h.set)).alias("sets"))
                        .dropDuplicates(["k1", "k2"]), "window-texts").filter("n_hit > 0")
    listed = texts.select("k1", "k2", F.explode("sets").alias("set")).join(sets, "set") \
        .select("k1", "k2", F.explode("items").alias("item")).groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    none = F.array().cast(listed.schema["items"].dataType)
    return texts.select("k1", "k2", "n_hit").join(listed, ["k1", "k2"], "left") \
        .select("k1", "k2", "n_hit", F.array_sort(F.coalesce("items", none)).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for every row of ``docs``."""
    hit = materialize(hit_texts(docs, items, text_col, **options), "contaminated")
    none = F.array().cast(hit.schema["items"].dataType)
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), n_words(text).alias("n_words"), *text_key(text)) \
        .join(hit, ["k1", "k2"], "left") \
        .select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"),
                F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of ``items`` occurs."""
    hit = materialize(hit_texts(docs, items, text_col, **options).select(F.struct("k1", "k2").alias("_hit")), "contaminated")
    return docs.join(hit, F.struct(*text_key(docs[text_col])) == F.col("_hit"), "left_anti")


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256)
