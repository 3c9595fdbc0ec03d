"""Text log lines to raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow.functions import strmap
from sloflow.functions.once import computed
from sloflow.functions.regex import Pattern, compile_pattern, group, matches

_MARK = "\x01"


def _one_pass_groups(line: Column, pattern: Pattern) -> Column:
    """All groups of the leftmost match as an array, with a single regex evaluation.

    The line is replaced by its marked and joined groups.  A line without a match is returned as it
    is by the replacement, so its text does not begin with the mark.
    """
    whole = f"\\A[\\s\\S]*?(?:{pattern.java})[\\s\\S]*\\z"
    template = _MARK + _MARK.join(f"${i}" for i in range(1, pattern.group_count + 1))
    return F.split(F.regexp_replace(line, F.lit(whole), F.lit(template)), _MARK, -1)


def parse_log_lines(
    df: DataFrame, line_re: str, empty_re: str = "^$", line_col: str = "value"
) -> DataFrame:
    """Add ``metadata``, ``quantity`` and ``malformed`` for each line.

    ``line_re`` is searched in the line; each named group becomes a key unless its text matches
    ``empty_re``.  Lines without a match are kept and flagged, see :func:`well_formed`.
    """
    pattern = compile_pattern(line_re)
    omit = compile_pattern(empty_re)
    line = F.col(line_col)
    matched = F.coalesce(matches(line, pattern), F.lit(False))
    if not pattern.names:
        return df.withColumns(
            {
                "metadata": F.when(matched, strmap.empty()),
                "quantity": F.lit(1.0),
                "malformed": ~matched,
            }
        )
    names = F.array(*[F.lit(name) for name in pattern.names])
    marked = line.contains(_MARK)
    fast = _one_pass_groups(line, pattern)
    slow = F.array(
        F.when(matched, F.lit("")),
        *[group(line, pattern, index) for index in range(1, pattern.group_count + 1)],
    )
    picked = df.withColumn("__groups", F.when(marked, slow).otherwise(fast))
    groups = F.col("__groups")
    well = F.coalesce(
        F.when(F.size(groups) == pattern.group_count + 1, groups[0] == ""), F.lit(False)
    )
    values = F.array(*[groups[index] for index in pattern.names.values()])
    metadata = F.map_filter(
        F.map_from_arrays(names, values), lambda _, value: ~matches(value, omit)
    )
    columns = {"metadata": F.when(well, metadata), "quantity": F.lit(1.0), "malformed": ~well}
    return computed(picked, columns).drop("__groups")


def well_formed(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("malformed")).drop("malformed")


def malformed(df: DataFrame) -> DataFrame:
    return df.filter("malformed")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of a file or folder; ``seq`` keeps the order of lines."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())


def read_log_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Follow a folder of rolled log files.

    The resume offset is the query's checkpoint, so give ``checkpointLocation`` to the writer.
    """
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
