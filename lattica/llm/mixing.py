"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], piecewise linear
with mean 1 and scaled by the source's target. Its integral is the cumulative
word demand; a document that fills words [c, c + n) of its source's stream
trains where that demand reaches the middle of the interval. Only column
expressions are used, and no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, bucket_count, checkpoint, running_sum

#: Weights by the rank of the source (code-point order, null last), repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; most uses of a source.
SHARE, MOST = 1.5, 2
#: Weight schedules by the same rank: knots (time, height) of mean 1. Falling, rising, level.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
    ((0.0, 1.0), (1.0, 1.0)),
)
SEED = "mix-1"
_HASH_RANGE = 16**5


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source_size, weight_rank, target.

    Targets share ``share`` of all words by weight; a target above ``most``
    times its source stops there, and the excess is shared again. Ordered by
    words per weight, the sources that stop are a prefix: the fill level after
    each prefix is one division, and the first source below its limit fixes it.
    Works on one row per source.
    """
    all_rows = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("weight_rank") + 1)
    per = (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("weight_rank", F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))).cast("int"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * most)
    )
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("limit").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    per = per.withColumn("level", level).withColumn("n", F.row_number().over(filling))
    free = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("n", "level"))
    per = per.withColumn("fill", F.min(free).over(all_rows)["level"])
    target = F.when(F.col("fill").isNull() | (F.col("limit") <= F.col("fill") * F.col("weight")), F.col("limit").cast("double")).otherwise(F.col("fill") * F.col("weight"))
    return per.select("source", "source_size", "weight_rank", target.alias("target"))


def training_time(rank: Column, share: Column, schedules=SCHEDULES) -> Column:
    """The time in [0, 1] by which ``share`` of a source's demand has arisen.

    Integrates the knots by trapezoids and solves the quadratic of the segment
    that holds the share. Heights must be positive and each schedule's integral 1.
    """
    by_rank = None
    for k, knots in enumerate(schedules):
        done, pieces = 0.0, []
        for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
            if min(h0, h1) <= 0 or t1 <= t0:
                raise ValueError("a schedule needs positive heights at rising times")
            slope, area = (h1 - h0) / (t1 - t0), (t1 - t0) * (h0 + h1) / 2
            rest = share - F.lit(done)
            if slope == 0:
                step = rest / F.lit(h0)
            else:
                step = (F.sqrt(F.greatest(F.lit(h0 * h0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(h0)) / F.lit(slope)
            pieces.append((done + area, F.lit(t0) + step))
            done += area
        if abs(done - 1) > 1e-9:
            raise ValueError("a schedule must integrate to 1")
        time = pieces[-1][1]
        for upto, value in reversed(pieces[:-1]):
            time = F.when(share <= upto, value).otherwise(time)
        by_rank = F.when(rank == k, time) if by_rank is None else by_rank.when(rank == k, time)
    return by_rank


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES, seed: str = SEED) -> DataFrame:
    """Per document: what the mix takes of it and when.

    Returns doc_id, source, size (words; null text 0), source_size, target,
    taken (words, repeats counted), takes: array of (epoch int, words long,
    position double). A source is read in the order of md5(seed, doc_id), over
    again if its target exceeds it; the last document is taken in part, so a
    source's taken words equal its target rounded. Documents without words take
    part with nothing taken. Rows equal in doc_id and size may swap; an empty
    table gives an empty one; further columns are left out.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = checkpoint(docs.select("doc_id", "source", words.alias("size")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    buckets = bucket_count(sizes.count())
    dealt = sizes.withColumn("order_key", key).withColumn("bucket", F.expr(f"({buckets} * cast(conv(substring(order_key, 1, 5), 16, 10) as bigint)) div {_HASH_RANGE}"))
    streams = running_sum(dealt, ["source"], "bucket", [F.col("order_key"), F.col("size")], "size", "begins")
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "t_source")
    joined = streams.join(targets, streams.source.eqNullSafe(targets.t_source)).withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))

    def take(epoch: int) -> Column:
        start = F.col("begins") + F.lit(epoch) * F.col("source_size")
        n = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("want") - start))
        middle = (start + n / F.lit(2.0)) / F.greatest(F.col("want"), F.lit(1))
        return F.struct(F.lit(epoch).alias("epoch"), n.alias("words"), training_time(F.col("weight_rank"), middle, schedules).alias("position"))

    takes = F.filter(F.array(*[take(e) for e in range(most)]), lambda x: x["words"] > 0)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return joined.withColumn("takes", takes).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes")


def in_training_order(df: DataFrame, position: str = "position", tie: str = "doc_id") -> DataFrame:
    """Range-sort by training position, ties by ``tie`` (so the never taken, which come last, spread over many ranges)."""
    order = [F.col(position).asc_nulls_last(), F.col(tie)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs``, one row per take.

    A document taken twice comes twice; one taken in part keeps its first words
    (and its n_chars follows). Documents are joined to their takes by doc_id and
    size; repeated rows equal in both are numbered so that each meets one plan row.
    """
    plan = plan_mix(docs, **options).filter("taken > 0")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = docs.withColumn("__size", words)
    repeated = not plan.groupBy("doc_id", "size").count().filter("count > 1").isEmpty()
    keys = ["__doc", "__n"]
    side = plan.select(F.col("doc_id").alias("__doc"), F.col("size").alias("__n"), F.col("takes").alias("__takes"))
    cond = counted.doc_id.eqNullSafe(side["__doc"]) & (counted["__size"] == side["__n"])
    if repeated:
        side = side.withColumn("__copy", F.row_number().over(Window.partitionBy(*keys).orderBy("__takes")))
        counted = counted.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "__size").orderBy("text", "source")))
        cond = counted.doc_id.eqNullSafe(side["__doc"]) & (counted["__size"] == side["__n"]) & (counted["__row"] == side["__copy"])
    each = counted.join(side, cond).withColumn("__take", F.explode("__takes"))
    ends = F.expr("__take.words < __size")
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(ends, F.array_join(F.slice(parts, 1, F.expr("int(__take.words)")), "")).otherwise(F.col("text"))
    out = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(ends, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return in_training_order(out.withColumn("__position", F.col("__take.position")), "__position").select(*docs.columns)
