"""Sequential ids and other windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.refs import are_consecutive, list_items, parse_sequential_id, parse_trailing_number
from traceline.operators import blocks
from traceline.storage import materialize

STEP = 65536


def expand_range(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """One row per integer of [first, last], expanded in two steps so no array grows with it."""
    steps = df.withColumn("_lo", first).withColumn("_hi", last).filter("_lo <= _hi").withColumn(
        "_at", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(STEP).cast("bigint"))))
    return steps.withColumn(
        out, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + STEP - 1, F.col("_hi"))))
    ).drop("_lo", "_hi", "_at")


def sequential_ids(components: DataFrame, kinds: list[str]) -> DataFrame:
    rows = components.filter(F.col("name").isin(kinds) & F.col("comp_id").isNotNull())
    # Exploding keeps the parse to one evaluation; a filter on it would be pushed down and repeated.
    parsed = F.filter(F.array(parse_sequential_id(F.col("comp_id"))), lambda p: p.isNotNull())
    return rows.select("doc_id", "comp_id", "ord", "line", "col", F.inline(parsed))


def sequential_id_order(components: DataFrame, kinds: list[str], block: int = blocks.BLOCK) -> DataFrame:
    """Ids not greater than the previous one of the same document, prefix and arity."""
    ids = sequential_ids(components, kinds)
    prev = blocks.lag(ids, ["doc_id", "prefix", "arity"], ["ord"], ["n", "m", "comp_id"], "prev", block)
    here, before = F.struct("n", "m"), F.struct("prev.n", "prev.m")
    return prev.filter(F.col("prev").isNotNull() & (here <= before)).select(
        "doc_id", "comp_id", "ord", "line", "col", F.col("prev.comp_id").alias("prev_id"))


def _level_gaps(values: DataFrame, keys: list[str]) -> DataFrame:
    """Missing integers 1..max of ``value`` per ``keys``, with the neighbours."""
    real = materialize(values.select(*keys, "value").distinct(), "levels")
    low = real.groupBy(*keys).agg(F.min("value").alias("lowest"))
    # A virtual zero makes the stretch before the first number a gap like any other.
    padded = real.unionByName(low.select(*keys, F.lit(0).cast("bigint").alias("value"))).distinct()
    nexts = blocks.lead(padded, keys, ["value"], ["value"], "nxt", STEP)
    gaps = nexts.filter(F.col("nxt.value") > F.col("value") + 1).select(
        *keys, F.col("value").alias("lo"), F.col("nxt.value").alias("hi")).join(low, keys)
    return expand_range(gaps, F.col("lo") + 1, F.col("hi") - 1, "missing").select(
        *keys, "missing", F.when(F.col("missing") > 1, F.col("missing") - 1).alias("after"),
        F.when(F.col("missing") == 1, F.col("lowest")).otherwise(F.col("hi")).alias("before"))


def sequential_id_gaps(components: DataFrame, kinds: list[str]) -> DataFrame:
    """Missing ids per document and prefix; prefixes of mixed arity are skipped.

    ``level`` is ``one`` for prefix-N, ``outer`` for a missing N of prefix-N-M and ``inner`` for a
    missing M.
    """
    ids = materialize(sequential_ids(components, kinds).select("doc_id", "prefix", "arity", "n", "m").distinct(),
                      "sequential-ids")
    shape = ids.groupBy("doc_id", "prefix").agg(F.min("arity").alias("lo"), F.max("arity").alias("hi"))
    pure = shape.filter("lo = hi").select("doc_id", "prefix", F.col("lo").alias("arity"))
    rows = ids.join(pure, ["doc_id", "prefix", "arity"], "left_semi")
    two = rows.filter("arity = 2")
    n_values = rows.select(
        "doc_id", "prefix", F.when(F.col("arity") == 1, "one").otherwise("outer").alias("level"),
        F.lit(None).cast("bigint").alias("n"), F.col("n").alias("value"))
    m_values = two.select("doc_id", "prefix", F.lit("inner").alias("level"), "n",
                          F.col("m").alias("value"))
    values = n_values.unionByName(m_values).withColumn("n", F.coalesce("n", F.lit(-1)))
    gaps = _level_gaps(values, ["doc_id", "prefix", "level", "n"])

    def label(v: Column) -> Column:
        return (
            F.when(F.col("level") == "one", F.concat_ws("-", "prefix", v))
            .when(F.col("level") == "outer", F.concat_ws("-", "prefix", v, F.lit("*")))
            .otherwise(F.concat_ws("-", "prefix", "n", v)))

    return gaps.select(
        "doc_id", "prefix", "level", label(F.col("missing")).alias("missing_id"),
        F.when(F.col("after").isNotNull(), label(F.col("after"))).alias("after_id"),
        label(F.col("before")).alias("before_id"))


def renumber_plan(components: DataFrame, kinds: list[str], block: int = blocks.BLOCK
                  ) -> tuple[DataFrame, DataFrame]:
    """(id edits, ``depends`` edits): ids become prefix-(rank of appearance)."""
    ids = components.filter(F.col("name").isin(kinds)).withColumn(
        "p", parse_trailing_number(F.col("comp_id"))).filter("p is not null").select(
        "doc_id", "comp_id", "ord", "line", "p.prefix", "p.number")
    ranked = blocks.row_number(ids, ["doc_id", "prefix"], ["ord"], "rank", block)
    edits = ranked.filter("number <> rank").select(
        "doc_id", "ord", "line", F.col("comp_id").alias("old_id"),
        F.concat_ws("-", "prefix", "rank").alias("new_id"))
    renames = edits.groupBy("doc_id", F.col("old_id").alias("item")) \
        .agg(F.max_by("new_id", "ord").alias("renamed"))
    users = components.filter(F.col("attrs")["depends"].isNotNull()).select(
        "doc_id", "ord", F.col("attrs")["depends"].alias("old_value"))
    items = users.select("*", F.posexplode(list_items(F.col("old_value"))).alias("pos", "item"))
    # One attribute's items come back together: the group is as long as one attribute value.
    depends = items.join(renames, ["doc_id", "item"], "left").groupBy("doc_id", "ord", "old_value").agg(
        F.count("renamed").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("renamed", "item").alias("item"))))
        .alias("parts"),
    ).filter("n > 0").select(
        "doc_id", "ord", "old_value",
        F.array_join(F.transform("parts", lambda p: p["item"]), ", ").alias("new_value"))
    return edits, depends


def next_sequential_id(components: DataFrame) -> DataFrame:
    """max + 1 of the first prefix seen, per document and component kind."""
    ids = components.withColumn("p", parse_trailing_number(F.col("comp_id"))) \
        .filter("p is not null").select("doc_id", "name", "ord", "p.*")
    tops = ids.groupBy("doc_id", "name", "prefix").agg(
        F.min("ord").alias("first_ord"), F.max("number").alias("top"))
    return tops.groupBy("doc_id", "name").agg(
        F.min_by(F.struct("prefix", "top"), "first_ord").alias("b")).select(
        "doc_id", "name", F.concat_ws("-", "b.prefix", (F.col("b.top") + 1)).alias("next_id"))


def _taken_suffixes(ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base, number, rank): suffix numbers from 2 already used by an id of the list, for
    bases that are ids themselves."""
    shaped = ids.select(*keys, "id").distinct().withColumn("p", parse_trailing_number(F.col("id"))) \
        .filter((F.col("p.number") >= 2) & (F.col("p.number") < 1 << 62)) \
        .select(*keys, F.col("p.prefix").alias("id"), F.col("p.number").cast("bigint").alias("number"))  # no list is longer
    based = shaped.join(ids.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")
    return blocks.row_number(based, [*keys, "id"], ["number"], "rank")


def deduplicate_ids(ids: DataFrame, keys: list[str], block: int = blocks.BLOCK) -> DataFrame:
    """Keep the first occurrence of an id, give later ones the next free numeric suffix.

    Suffixed names of different bases never meet, so the j-th repeat of a base gets its j-th free
    suffix: with i taken numbers below it that is j + 1 + i.  Which i applies is carried forward
    along the free positions, without gathering a group.
    ``ids`` has ``keys``, ``id`` and the unique integer ``ord``.
    """
    ranked = blocks.row_number(ids, [*keys, "id"], ["ord"], "nth", block)
    taken = _taken_suffixes(ids, keys).select(
        *keys, "id", (F.col("number") - 1 - F.col("rank")).alias("pos"), F.lit(1).alias("kind"),
        F.col("rank").alias("seen"), F.lit(None).cast("bigint").alias("ord"))
    repeats = ranked.filter("nth > 1").select(
        *keys, "id", (F.col("nth") - 1).alias("pos"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("seen"), F.col("ord").cast("bigint"))
    events = blocks.carry_forward(
        taken.unionByName(repeats), [*keys, "id"], ["pos", "kind", "seen"],
        {"passed": F.col("seen")})
    renamed = events.filter("kind = 0").select(
        *keys, "id", "ord",
        F.concat_ws("-", "id", F.col("pos") + 1 + F.coalesce("passed", F.lit(0))).alias("new_id"))
    kept = ranked.filter("nth = 1").select(*keys, "id", F.col("ord").cast("bigint"),
                                           F.col("id").alias("new_id"))
    return kept.unionByName(renamed)


def unique_suffix(ids: DataFrame, keys: list[str]) -> DataFrame:
    """For every repeated id the smallest free ``id-n``, n >= 2."""
    repeated = ids.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    run = _taken_suffixes(ids, keys).filter("number - rank = 1") \
        .groupBy(*keys, "id").agg(F.max("number").alias("last"))
    return repeated.join(run, [*keys, "id"], "left").select(
        *keys, "id", F.concat_ws("-", "id", F.coalesce("last", F.lit(1)) + 1).alias("suggestion"))


def excess_rationales(components: DataFrame) -> DataFrame:
    """Every Rationale of a Decision after the first."""
    rows = components.filter("name = 'Rationale' and parent_name = 'Decision'")
    first = rows.groupBy("doc_id", "parent_path").agg(F.min("ord").alias("first_ord"))
    return rows.join(first, ["doc_id", "parent_path"]).filter("ord > first_ord")


def completed_ranges(tasks: DataFrame, order: str = "ord", block: int = blocks.BLOCK) -> DataFrame:
    """Runs of consecutive completed task ids per document, one row per run.

    ``tasks`` holds completed tasks only, with ``doc_id``, ``comp_id`` and the order column.
    """
    rows = tasks.select("doc_id", "comp_id", order)
    prev = materialize(blocks.lag(rows, ["doc_id"], [order], ["comp_id"], "prev", block), "task-runs")
    starts = prev.withColumn("starts", (
        ~F.coalesce(are_consecutive(F.col("prev.comp_id"), F.col("comp_id")), F.lit(False))).cast("int"))
    runs = blocks.running_sum(starts, ["doc_id"], [order], F.col("starts"), "run", block)
    ends = runs.groupBy("doc_id", "run").agg(
        F.min_by("comp_id", order).alias("first_id"), F.max_by("comp_id", order).alias("last_id"),
        F.count(F.lit(1)).alias("n_tasks"))
    return ends.select(
        "doc_id", "run", "n_tasks",
        F.when(F.col("n_tasks") == 1, F.col("first_id"))
        .otherwise(F.concat_ws(" .. ", "first_id", "last_id")).alias("label"))
