"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source, targets follow from weights, and a source's rate is its target
over its size. A document is emitted floor(rate) times and once more if its own hash falls below
the fraction of the rate. Rows that repeat a document are numbered, so each has a hash of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespan.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240229
#: Equal rows are counted before they are shuffled and numbered again by so many a row.
RUN = 4096


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(seed: int, *more: Column) -> Column:
    """A number in [0, 1) that depends on a row's doc_id, source and text, and ``more``."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                      F.coalesce("source", F.lit("")), F.md5(F.coalesce("text", F.lit(""))), *more)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size; a row a source) with weight, target and rate.

    Sources by code point, null last, take the weights in turn and share the total by weight. A
    target stops at ``max_repeats`` times its source; what it leaves over goes to the others by
    weight. Sources stop in the order of limit over weight, so one running sum finds the common
    share per weight of those that don't. A source of size 0 has target and rate 0.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn.cast("long"))
    limit = F.lit(max_repeats) * F.col("source_size")
    order = [(limit / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    spent = F.coalesce(F.sum(limit).over(before), F.lit(0))
    share = ((total - spent) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rows = rows.withColumn("share", share)
    # the first source that stays under its limit sets the share of all that follow; counting it
    # as stopped would leave less, so its share is the greatest of those under their limits
    level = F.max(F.when(F.col("share") * F.col("weight") <= limit, F.col("share"))).over(every)
    target = F.when(limit / F.col("weight") <= level, limit.cast("double")).otherwise(
        level * F.col("weight"))
    rows = rows.withColumn("target", F.coalesce(target, limit.cast("double")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"),
                                                    F.lit(float(max_repeats)))).otherwise(0.0)
    return rows.select("source", "source_size", "weight", "target", rate.alias("rate"))


def _numbered(docs: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose __key is in ``again``, with __nth among rows equal in all columns.

    Equal rows meet as counts and are spread before they are repeated, so no task holds them all.
    """
    counts = docs.join(again, "__key", "left_semi").groupBy(*docs.columns).agg(
        F.count("*").alias("__times"))
    runs = counts.withColumn("__run", F.explode(F.expr(f"sequence(0, (__times - 1) div {RUN})")))
    nth = F.explode(F.expr(f"sequence(__run * {RUN} + 1, least(__times, (__run + 1) * {RUN}))"))
    return runs.repartition("__key", "__run").withColumn("__nth", nth).drop("__times", "__run")


def _planned(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies.

    The source table is stored, so Spark knows its bytes: it is broadcast under Spark's threshold
    and joined with skew handling beyond it. So are the keys of rows that occur again.
    """
    key = F.xxhash64("doc_id", "source", "text")
    again = stored(docs.select(key.alias("__key")).groupBy("__key").count().where("count > 1")
                   .select("__key"))
    others = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns
              if c not in ("doc_id", "source", "text")]
    rows = docs.withColumn("__coin", coin(seed))
    if not again.isEmpty():
        keyed = docs.withColumn("__key", key)
        own = coin(seed, *others, F.col("__nth").cast("string"))
        rows = (keyed.join(again, "__key", "left_anti").withColumn("__coin", coin(seed))
                .unionByName(_numbered(keyed, again).withColumn("__coin", own).drop("__nth"))
                .drop("__key"))
    table = stored(targets(docs.groupBy("source").agg(F.sum(words("text")).alias("source_size")),
                           weights, max_repeats))
    table = table.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"),
                         F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    joined = rows.withColumn("__size", words("text")).join(
        table, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    floor = F.floor("__rate")
    copies = floor + (F.col("__coin") < F.col("__rate") - floor).cast("long")
    return joined.withColumn("__copies", copies.cast("long")).drop("__rate", "__coin")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
         seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and copies for every row of ``docs`` (doc_id, text,
    source).

    A null text has size 0, a null source is a source of its own, and a row without ``doc_id``
    tosses its coin by source and text. Rows equal in all three toss by the other columns and
    their number among equal rows too, each for itself.
    """
    rows = _planned(docs, weights, max_repeats, seed)
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c)
                                   for c in ("size", "source_size", "target", "copies")])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        seed: int = SEED) -> DataFrame:
    """The mixed rows themselves: ``docs``, all its columns, with each row repeated as planned."""
    rows = _planned(docs, weights, max_repeats, seed).where("__copies > 0")
    return rows.select(*docs.columns, F.explode(F.expr("sequence(1, int(__copies))")).alias(
        "__copy")).drop("__copy")
