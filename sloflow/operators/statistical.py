"""Guessing the classification of unclassified events from recent class frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloflow.functions.once import computed
from sloflow.operators.shape import classification, is_classified

GUESSED_APP = "statistically-guessed"  # fixed value


def _interval(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def class_counts(df: DataFrame, interval: int = 60, ts: str = "event_time") -> DataFrame:
    """Classified events per interval, domain and class (``interval_no``, ``weight``)."""
    return (
        df.filter(is_classified())
        .groupBy(
            _interval(F.col(ts), interval).alias("interval_no"),
            F.col("classification.domain").alias("domain"),
            F.col("classification.class").alias("class"),
        )
        .agg(F.count("*").cast("double").alias("weight"))
    )


def class_weights(
    df: DataFrame, window: int = 1800, interval: int = 60, ts: str = "event_time", earlier: DataFrame | None = None
) -> DataFrame:
    """Weights in force: ``(domain, class, since, until, weight)`` with interval numbers, ``until`` not included.

    The weight of an interval is the sum of the counts of the ``window / interval`` intervals before it, so only
    completed intervals count.  A count comes in with the next interval and goes out after the window: two
    changes, whose running sum is the weight, however many intervals the window has.  ``earlier`` are the
    :func:`class_counts` of events that ``df`` does not hold.
    """
    if interval <= 0:
        raise ValueError("the update interval must be above zero")
    length = window // interval
    counts = class_counts(df, interval, ts)
    if earlier is not None:
        counts = counts.unionByName(earlier.select(*counts.columns))
    changes = counts.select(
        "domain",
        "class",
        F.inline(
            F.array(
                F.struct((F.col("interval_no") + 1).alias("since"), F.col("weight").alias("change")),
                F.struct((F.col("interval_no") + 1 + length).alias("since"), (-F.col("weight")).alias("change")),
            )
        ),
    )
    along = Window.partitionBy("domain", "class").orderBy("since")
    return (
        changes.groupBy("domain", "class", "since")
        .agg(F.sum("change").alias("change"))
        .withColumns(
            {
                "until": F.lead("since").over(along),
                "weight": F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .filter(F.col("weight") > 0)
        .drop("change")
    )


#: Equal parts of the unit interval by which a drawn number meets the classes that it may fall to.
_SLOTS = 64


def _distribution(weights: DataFrame, needed: DataFrame) -> DataFrame:
    """The classes of each needed interval as stretches of its total weight, in order of domain and class.

    Each row is one class in one of the slots it reaches into: ``(interval_no, slot, low, upto, total, domain, class)``.
    """
    each = weights.withColumn("interval_no", F.explode(F.sequence(F.col("since"), F.col("until") - 1)))
    own = Window.partitionBy("interval_no")
    placed = each.join(needed, "interval_no", "left_semi").withColumns(
        {
            "upto": F.sum("weight").over(own.orderBy("domain", "class").rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("weight").over(own),
        }
    )
    low = F.col("upto") - F.col("weight")
    # A little wider than the stretch, as the draw is rounded; the stretch itself decides.
    first = F.floor(low / F.col("total") * _SLOTS - 1e-6).cast("int")
    last = F.floor(F.col("upto") / F.col("total") * _SLOTS + 1e-6).cast("int")
    return placed.select(
        "interval_no",
        F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(_SLOTS - 1)))).alias("slot"),
        low.alias("low"),
        "upto",
        "total",
        "domain",
        "class",
    )


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends only on the given columns."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def classify_statistical(
    df: DataFrame,
    window: int = 1800,
    interval: int = 60,
    defaults: Sequence[tuple[str, str, float]] = (),
    ts: str = "event_time",
    ident: str = "event_id",
    seed: int = 0,
    history: bool = True,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Give unclassified events a class drawn by the weights of the preceding window.

    Without weights the ``defaults`` ``(domain, class, weight)`` are used; without those, or if
    they sum to zero, the event is dropped.  The draw is a function of the event's id and the seed,
    so a repeated run gives the same result.  An event meets the few classes whose stretch reaches into the
    slot of its draw, so neither a busy interval nor one with many classes is a single row or task.

    ``earlier`` are the :func:`class_counts` of events before these.
    ``history=False`` uses the defaults alone, for events whose times say nothing.
    """
    listed, default_total = [], 0.0
    for domain, class_, weight in sorted(defaults):
        default_total += weight
        listed.append(
            F.struct(
                F.lit(float(default_total)).alias("upto"), F.lit(domain).alias("domain"), F.lit(class_).alias("class")
            )
        )
    draw = uniform(F.lit(seed), F.col(ident))
    if history:
        asks = F.when(~is_classified(), _interval(F.col(ts), interval))
        asked = df.withColumns({"__interval": asks, "__draw": draw}).withColumn("__slot", F.floor(F.col("__draw") * _SLOTS).cast("int"))
        needed = df.select(asks.alias("interval_no")).filter("interval_no IS NOT NULL").distinct()
        found = _distribution(class_weights(df, window, interval, ts, earlier), needed)
        found = found.withColumnsRenamed({name: f"__d_{name}" for name in found.columns})
        point = F.col("__draw") * F.col("__d_total")
        within = (F.col("__d_low") <= point) & (point < F.col("__d_upto"))
        same = (F.col("__interval") == F.col("__d_interval_no")) & (F.col("__slot") == F.col("__d_slot")) & within
        joined = asked.join(found, same, "left")
        drawn = F.when(F.col("__d_total").isNotNull(), F.struct(F.col("__d_domain").alias("domain"), F.col("__d_class").alias("class")))
    else:
        joined = df.withColumn("__draw", draw)
        drawn = F.lit(None).cast("struct<domain:string,class:string>")
    if listed:
        chosen = F.get(F.filter(F.array(*listed), lambda c: c["upto"] > F.col("__draw") * default_total), 0)
        drawn = F.coalesce(drawn, F.when(chosen.isNotNull(), F.struct(chosen["domain"].alias("domain"), chosen["class"].alias("class"))))
    guess = F.when(
        drawn.isNotNull(), classification(drawn["domain"], F.lit(GUESSED_APP), drawn["class"])
    )
    own = is_classified()
    columns = {
        "statistical_result": F.when(own, "increased-weight")
        .when(F.col("__guess").isNotNull(), "classified")
        .otherwise("unclassified"),
        "classification": F.when(own, F.col("classification")).otherwise(F.col("__guess")),
    }
    return (
        computed(joined.withColumn("__guess", F.when(~own, guess)), columns)
        .filter(F.col("statistical_result") != "unclassified")
        .select(*df.columns, "statistical_result")
    )
