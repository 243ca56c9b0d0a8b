"""Nearest document ids for broken references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.storage import materialize, spread

MIN_SCORE = 0.6
ROWS_PER_TASK = 100_000  # known names that a task makes shorter ones of


def damerau_levenshtein(left: Column, right: Column) -> Column:
    """Damerau-Levenshtein distance with unrestricted adjacent transpositions.

    The rows of the matrix are folded by Spark's own higher-order functions.  A row of ``left`` and a column
    of ``right`` have one cell more in front, which is too large for any path.
    """
    n, m = F.length(left), F.length(right)
    top = n + m
    start = F.array(F.array_repeat(top, m + 2), F.concat(F.array(top), F.sequence(F.lit(0), m)))

    def next_row(rows: Column, i: Column) -> Column:
        x = F.substring(left, i, F.lit(1))
        before = F.reverse(F.substring(left, F.lit(1), i - 1))

        def next_cell(cells: Column, j: Column) -> Column:
            y = F.substring(right, j, F.lit(1))
            back = F.call_function("instr", before, y)
            row, col = F.when(back == 0, 0).otherwise(i - back), cells["equal"]  # where both characters stood last
            cell = F.least(
                F.get(F.get(rows, i), j) + F.when(x == y, 0).otherwise(1), F.get(cells["row"], j) + 1, F.get(F.get(rows, i), j + 1) + 1,
                F.get(F.get(rows, row), col) + (i - row - 1) + 1 + (j - col - 1))
            return F.struct(F.array_append(cells["row"], cell).alias("row"), F.when(x == y, j).otherwise(col).alias("equal"))

        first = F.struct(F.array(top, i).alias("row"), F.lit(0).alias("equal"))
        return F.array_append(rows, F.aggregate(_up_to(m), first, next_cell, lambda cells: cells["row"]))

    return F.aggregate(_up_to(n), start, next_row, lambda rows: F.get(F.get(rows, n + 1), m + 1))


def _up_to(n: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)


def _deletions(text: Column, count: int) -> Column:
    """Hashes of ``text`` with up to ``count`` characters left out."""
    texts = F.array(text)
    for _ in range(count):
        shorter = F.flatten(F.transform(texts, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))))
        texts = F.array_distinct(F.concat(texts, shorter))
    return F.transform(texts, lambda t: F.xxhash64(t))


def _pieces(text: Column, count: Column) -> Column:
    """``count`` consecutive pieces of ``text`` and where they begin, as even as possible."""
    n = F.length(text)
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            F.floor(i * n / count).cast("int").alias("at"),
            F.substring(text, F.floor(i * n / count).cast("int") + 1,
                        (F.floor((i + 1) * n / count) - F.floor(i * n / count)).cast("int")).alias("piece")))


def nearest_names(wanted: DataFrame, known: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Best ``name`` of ``known(name, path)`` for each ``wanted(target_doc)``.

    The score is 1 - distance / longer length and must reach ``min_score``; ties go to the first
    path.  Distances 1 and 2 are found by an equi join on the texts with up to that many characters
    left out, which both sides of such a pair share.  A name found that way may only lose to a
    farther one when it is very short, and those names go on to the last stage (``far_pairs``).  Every
    distance is computed only for the pairs so found.
    """
    names = wanted.select("target_doc").filter("target_doc is not null").distinct()
    names = materialize(names, "wanted")
    pool = spread(known.select("name", "path"), "name", ROWS_PER_TASK)  # a repeated row changes no least score or path

    def scored(pairs: DataFrame) -> DataFrame:
        longer = F.greatest(F.length("target_doc"), F.length("name"))
        # A transposition is two plain edits.
        near = pairs.filter(F.levenshtein("target_doc", "name") <= 2 * F.floor(longer * (1 - min_score) + 1e-9))
        # Exploded, so that the distance is computed once and not again in the filter.
        return near.withColumn("distance", F.explode(F.array(damerau_levenshtein(F.col("target_doc"), F.col("name"))))) \
            .withColumn("score", 1 - F.col("distance") / longer).filter(F.col("score") >= min_score)

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("target_doc").agg(
            F.min_by(F.struct("name", "score", "distance"), F.struct(-F.col("score"), F.col("path"))).alias("b")
        ).select("target_doc", F.col("b.name").alias("nearest"), "b.score", "b.distance")

    found = None
    rest = names
    for k in (1, 2):
        if rest.isEmpty():
            break
        lo, hi = rest.agg(F.min(F.length("target_doc")), F.max(F.length("target_doc"))).first()
        near = pool.filter(F.length("name").between(lo - k, hi + k))
        left = rest.select("target_doc", F.explode(_deletions(F.col("target_doc"), k)).alias("h"))
        right = near.select("name", "path", F.explode(_deletions(F.col("name"), k)).alias("h"))
        pairs = left.join(right, "h").filter(
            F.abs(F.length("target_doc") - F.length("name")) <= k).select("target_doc", "name", "path").distinct()
        hits = best(scored(pairs).filter(F.col("distance") <= k))
        # A name farther away could score as well only if distance^2 + distance reaches the length.
        sure = materialize(hits.filter(
            F.col("distance") * (F.col("distance") + 1) < F.length("target_doc")), "nearest")
        found = sure if found is None else found.unionByName(sure)
        rest = materialize(rest.join(sure, "target_doc", "left_anti"), "rest")
    if rest.isEmpty():
        return found if found is not None else best(scored(names.join(pool, names.target_doc == pool.name)))

    far = best(scored(far_pairs(rest, pool, min_score)))
    return far if found is None else found.unionByName(far)


def far_pairs(rest: DataFrame, pool: DataFrame, min_score: float) -> DataFrame:
    """(target_doc, name, path): pairs that may be within the edits k that the score allows for their lengths.

    k edits touch at most 2k of 2k + 1 pieces of the wanted name, so one of them stands in the other
    name.  If that is d characters longer, the edits before and after the piece allow a shift of
    (d - k) / 2 to (d + k) / 2 only, so pairs come from an equi join on lengths, piece and place.
    """
    lengths = pool.select(F.length("name").alias("len")).distinct()
    left = rest.withColumn("n", F.length("target_doc"))
    reach = left.select("n").distinct().withColumn(
        "len", F.explode(F.sequence(F.ceil(F.col("n") * min_score).cast("int"),
                                    F.floor(F.col("n") / min_score).cast("int")))) \
        .join(lengths, "len").withColumn(
        "k", F.floor(F.greatest("n", "len") * (1 - min_score) + 1e-9).cast("int"))
    q = left.join(reach, "n").withColumn("parts", F.least(2 * F.col("k") + 1, F.greatest("n", F.lit(1))))
    q = q.select("target_doc", "n", "len", "k", F.explode(_pieces(F.col("target_doc"), F.col("parts"))).alias("p")) \
        .select("target_doc", "n", "len", "k", F.length("p.piece").alias("size"), "p.piece", "p.at")
    longer = F.col("len") - F.col("n")
    q = q.withColumn("low", F.greatest(F.lit(0), F.col("at") + F.ceil((longer - F.col("k")) / 2).cast("int"))) \
        .withColumn("high", F.least(F.col("len") - F.col("size"), F.col("at") + F.floor((longer + F.col("k")) / 2).cast("int"))) \
        .filter("low <= high")
    q = q.select("target_doc", "len", "size", "piece", F.explode(F.sequence("low", "high")).alias("at")).distinct()
    sizes = q.select("len", "size").distinct()
    r = pool.withColumn("len", F.length("name")).join(sizes, "len").filter("size <= len").select(
        "name", "path", "len", "size", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))).alias("at"))
    r = r.withColumn("piece", F.substring(F.col("name"), F.col("at") + 1, F.col("size")))
    return q.join(r, ["len", "size", "piece", "at"]).select("target_doc", "name", "path").distinct()


def nearest_document(broken: DataFrame, documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(target_doc, nearest, score, distance) for references to missing documents."""
    wanted = broken.filter("reason = 'document_not_found'").select("target_doc")
    return nearest_names(wanted, documents.select(F.col("doc_id").alias("name"), "path"), min_score)
