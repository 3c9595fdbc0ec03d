"""Classification of events by their key: learned, exact and regular-expression matchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import computed
from sloflow.functions.regex import RegexError, compile_pattern, matches, required_texts
from sloflow.functions.text import metadata_label
from sloflow.operators.scan import time_chunk, with_previous
from sloflow.operators.shape import classification, event_key, is_classified
from sloflow.sources.matchers import Matcher, matchers_df, valid_patterns

_NO_CLASS = "struct<domain:string,app:string,class:string>"

# How an event came to its classification.
EXACT = "exact"
REGEXP = "regexp"


def exact_table(matchers: DataFrame) -> DataFrame:
    """One classification per endpoint: the last row of an endpoint counts."""
    return matchers.groupBy("endpoint").agg(
        F.max_by(
            classification(F.col("domain"), F.col("app"), F.col("class")), F.col("ord")
        ).alias("__exact")
    )


def with_exact(df: DataFrame, matchers: DataFrame, key: str = "event_key") -> DataFrame:
    """Add ``__exact``: the classification of the row's key in the matcher table, or NULL.

    A table made by :func:`~sloflow.sources.matchers.matchers_df` is broadcast up to its row limit,
    any other one if Spark finds it small enough; larger tables are shuffled, and AQE splits the
    partitions of hot keys.
    """
    table = exact_table(matchers)
    return df.join(table, df[key] == table["endpoint"], "left").drop("endpoint")


def regexp_class(key: Column, matchers: Sequence[Matcher]) -> Column:
    """Classification of the first matching pattern in file order, or NULL.

    Patterns are literals in one CASE expression: each task compiles them once, and rows are
    neither shuffled nor paired with patterns.
    """
    chosen = None
    for matcher in valid_patterns(matchers):
        found = matches(key, compile_pattern(matcher.endpoint))
        value = classification(F.lit(matcher.domain), F.lit(matcher.app), F.lit(matcher.class_))
        chosen = F.when(found, value) if chosen is None else chosen.when(found, value)
    return F.lit(None).cast(_NO_CLASS) if chosen is None else chosen


#: Beyond so many patterns, keys look up the patterns that they may match.
PATTERNS_PER_ROW = 8
_GRAM = 3


def pattern_index(matchers: DataFrame) -> DataFrame:
    """An index of ``matchers`` (ord, domain, app, class, endpoint): ``(gram, ord, java, found)``.

    Every valid pattern stands under one text of up to three characters that each of its matches contains: the
    one that the fewest patterns share.  A pattern without such a text stands under the empty one.  Invalid
    patterns are left out.  Patterns are read by Python code on the executors, as many as the table has.
    """
    given = [F.col(c).cast(t).alias(c) for c, t in (("ord", "long"), ("domain", "string"), ("app", "string"), ("class", "string"), ("endpoint", "string"))]
    parsed = matchers.select(*given).mapInPandas(_parsed, "ord long, domain string, app string, class string, java string, grams array<string>")
    grams = parsed.select("ord", "java", classification(F.col("domain"), F.col("app"), F.col("class")).alias("found"), F.explode("grams").alias("gram"))
    sharing = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "gram", "java", "found")).alias("best")
    return grams.join(sharing, "gram").groupBy("ord").agg(rarest).select("best.gram", "ord", "best.java", "best.found")


def _parsed(frames):
    import pandas as pd

    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            try:
                java = compile_pattern(row.endpoint).java
            except (RegexError, TypeError):
                continue
            texts = required_texts(row.endpoint)
            grams = {t[i : i + _GRAM] for t in texts for i in range(len(t) - _GRAM + 1)} or {t for t in texts}
            rows.append((*row[:4], java, sorted(grams) or [""]))
        yield pd.DataFrame(rows, columns=["ord", "domain", "app", "class", "java", "grams"])


def _grams(key: Column) -> Column:
    """The empty text and all texts of up to three characters in a key."""

    def of(size: int) -> Column:
        places = F.when(F.length(key) >= size, F.sequence(F.lit(1), F.length(key) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(key, i, F.lit(size)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(size) for size in range(1, _GRAM + 1)]))


def match_keys(keys: DataFrame, index: DataFrame, key: str = "__key") -> DataFrame:
    """The first matching pattern by ``ord`` of each distinct key that has one: ``(key, __found)``.

    Keys meet patterns by the texts that they contain, so the work follows the candidates and not keys times patterns.
    """
    asked = keys.select(key, F.explode(_grams(F.col(key))).alias("gram"))
    fit = asked.join(index, "gram").filter(F.expr(f"`{key}` rlike java"))
    return fit.groupBy(key).agg(F.min_by("found", "ord").alias("__found"))


def with_regexp(df: DataFrame, matchers: Sequence[Matcher] | DataFrame, key: str = "event_key", needed: Column | None = None) -> DataFrame:
    """Add ``__regexp``: the classification by pattern where ``needed``, else NULL.

    A few patterns are a column.  More of them, or a table (as of
    :func:`~sloflow.sources.matchers.matchers_df`), become an index: the keys are reduced to distinct ones, looked
    up and joined back; AQE splits the partitions of hot keys.  A stream has no end to wait for and keeps the
    column; per micro-batch, as in ``classify_stream``, it uses the index.
    """
    needed = F.lit(True) if needed is None else needed
    if not isinstance(matchers, DataFrame):
        if df.isStreaming or len(matchers) <= PATTERNS_PER_ROW:
            return df.withColumn("__regexp", F.when(needed, regexp_class(F.col(key), matchers)))
        matchers = matchers_df(df.sparkSession, valid_patterns(matchers))
    if df.isStreaming:
        raise ValueError("a table of patterns is looked up per micro-batch, see classify_stream")
    found = match_keys(df.filter(needed).select(F.col(key).alias("__key")).distinct(), pattern_index(matchers))
    return df.join(found, df[key] == found["__key"], "left").withColumn("__regexp", F.when(needed, F.col("__found"))).drop("__key", "__found")


def with_learned(
    df: DataFrame,
    order: Sequence[str] = ("event_time", "event_id"),
    chunk: Column | None = None,
    key: str = "event_key",
) -> DataFrame:
    """Add ``__learned`` and ``__seen`` from earlier events of the same key.

    ``__learned`` is the classification of the latest earlier classified event, ``__seen`` whether
    the key occurred before at all.
    """
    chunk = time_chunk(F.col(order[0])) if chunk is None else chunk
    return with_previous(
        df,
        [key],
        order,
        {
            "__learned": (F.col("classification"), is_classified()),
            "__seen": (F.lit(True), None),
        },
        chunk,
    )


def classify_learned(
    df: DataFrame, order: Sequence[str] = ("event_time", "event_id"), chunk: Column | None = None
) -> DataFrame:
    """Give unclassified events the latest earlier classification of their key."""
    keyed = df.withColumn("event_key", event_key()) if "event_key" not in df.columns else df
    found = with_learned(keyed, order, chunk)
    return found.withColumn(
        "classification",
        F.when(is_classified(), F.col("classification")).otherwise(
            F.coalesce("__learned", "classification")
        ),
    ).drop("__learned", "__seen")


def classify_exact(df: DataFrame, matchers: DataFrame) -> DataFrame:
    keyed = df.withColumn("event_key", event_key()) if "event_key" not in df.columns else df
    found = with_exact(keyed, matchers)
    return found.withColumn(
        "classification",
        F.when(is_classified(), F.col("classification")).otherwise(
            F.coalesce("__exact", "classification")
        ),
    ).drop("__exact")


def classify_regexp(df: DataFrame, matchers: Sequence[Matcher] | DataFrame) -> DataFrame:
    keyed = df.withColumn("__event_key", event_key())
    return (
        with_regexp(keyed, matchers, "__event_key", ~is_classified())
        .withColumn("classification", F.coalesce("__regexp", "classification"))
        .drop("__regexp", "__event_key")
    )


def decide(df: DataFrame, regexp: Sequence[Matcher] | DataFrame) -> DataFrame:
    """Choose among own, ``__learned``, ``__exact`` and regular-expression classification.

    ``classified_by`` is NULL for events that came classified and empty for those that stay
    unclassified.  A regular expression counts as the source only on the first event of a key: its
    result is remembered like an exact match.
    """
    own = is_classified()
    found = with_regexp(df, regexp, needed=~own & F.col("__learned").isNull() & F.col("__exact").isNull())
    known = F.col("__learned").isNotNull() | F.col("__exact").isNotNull()
    by_regexp = F.col("__regexp").isNotNull()
    source = (
        F.when(known | (by_regexp & F.col("__seen").isNotNull()), EXACT)
        .when(by_regexp, REGEXP)
        .otherwise("")
    )
    columns = {
        "classified_by": F.when(~own, source),
        "classification": F.when(own, F.col("classification")).otherwise(
            F.coalesce("__learned", "__exact", "__regexp", "classification")
        ),
    }
    return computed(found, columns).drop("__learned", "__exact", "__regexp", "__seen")


def classify_dynamic(
    df: DataFrame,
    exact: DataFrame | None = None,
    regexp: Sequence[Matcher] | DataFrame = (),
    order: Sequence[str] = ("event_time", "event_id"),
    chunk: Column | None = None,
    remembered: DataFrame | None = None,
) -> DataFrame:
    """Own classification, else learned, else exact, else regular expression, else unchanged.

    ``remembered`` is what an earlier run left behind, see :func:`remember`.
    """
    keyed = df.withColumn("event_key", event_key())
    found = with_learned(keyed, order, chunk)
    if remembered is not None:
        found = _with_remembered(found, remembered)
    if exact is None:
        found = found.withColumn("__exact", F.lit(None).cast(_NO_CLASS))
    else:
        found = with_exact(found, exact)
    return decide(found, regexp)


def _with_remembered(found: DataFrame, remembered: DataFrame) -> DataFrame:
    """Fill ``__learned`` and ``__seen`` from an earlier run where this run has nothing yet."""
    table = remembered.select(
        F.col("event_key").alias("__key"), F.col("learned").alias("__old"), F.lit(True).alias("__known")
    )
    return (
        found.join(table, found["event_key"] == table["__key"], "left")
        .withColumns(
            {
                "__learned": F.coalesce("__learned", "__old"),
                "__seen": F.coalesce("__seen", "__known"),
            }
        )
        .drop("__key", "__old", "__known")
    )


def remember(
    df: DataFrame,
    remembered: DataFrame | None = None,
    order: Sequence[str] = ("event_time", "event_id"),
) -> DataFrame:
    """What later runs must know: per key the last own classification, ``(event_key, learned)``.

    ``df`` is a result of :func:`classify_dynamic`, ``remembered`` what was known before it.
    """
    position = F.struct(*[F.col(c) for c in order])
    own = F.when(F.col("classified_by").isNull(), position)
    fresh = df.groupBy("event_key").agg(F.max_by("classification", own).alias("learned"))
    if remembered is None:
        return fresh
    old = remembered.select(F.col("event_key").alias("__key"), F.col("learned").alias("__old"))
    return fresh.join(old, fresh["event_key"] == old["__key"], "full").select(
        F.coalesce("event_key", "__key").alias("event_key"),
        F.coalesce("learned", "__old").alias("learned"),
    )


def classification_report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count the events that did not come classified, by result and source.

    The values of ``keys`` are reported for events that stay unclassified and are empty otherwise.
    """
    result = F.when(F.col("classified_by") == "", "unclassified").otherwise("classified")
    labels = [
        F.when(result == "unclassified", F.coalesce(strmap.lookup(F.col("metadata"), key), F.lit("")))
        .otherwise("")
        .alias(metadata_label(key))
        for key in sorted(keys)
    ]
    return (
        df.filter(F.col("classified_by").isNotNull())
        .groupBy(result.alias("result"), "classified_by", *labels)
        .agg(F.count("*").alias("events"))
    )


def learned_matchers(df: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """The exact matchers after all events: given ones overlaid with learned classifications.

    Takes events as returned by :func:`classify_dynamic`, and includes remembered regular
    expression results, like a dump of the running classifier would.
    """
    position = F.struct("event_time", "event_id")
    rank = F.struct(F.col("classified_by").isNull().alias("own"), position.alias("at"))
    remembered = (
        df.filter(is_classified())
        .groupBy(F.col("event_key").alias("endpoint"))
        .agg(F.max_by("classification", rank).alias("c"))
    )
    rows = remembered.select("c.domain", "c.app", "c.class", "endpoint")
    if exact is None:
        return rows
    given = exact_table(exact).select("__exact.domain", "__exact.app", "__exact.class", "endpoint")
    return rows.unionByName(given.join(rows, "endpoint", "left_anti").select(*rows.columns))
