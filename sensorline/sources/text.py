"""Text recordings: lists of timestamps, logs, and plain documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import finite, neighbours
from .readers import with_row_index

#: The public line format of glog, [IWEF]mmdd hh:mm:ss.uuuuuu threadid file:line] msg, put together from its fields.
_FIELDS = {
    "level": "[IWEF]", "month": "0[1-9]|1[0-2]", "day": "0[1-9]|[12][0-9]|3[01]", "hour": "[01][0-9]|2[0-3]", "minute": "[0-5][0-9]", "second": "[0-5][0-9]|60",
    "fraction": "[0-9]{1,6}", "thread": "[0-9]+", "source": "[^\\]]+", "message": ".*",
}
LOG = "^{level}{month}{day}[ \\t]+{hour}:{minute}:{second}[.]{fraction}[ \\t]+{thread}[ \\t]+{source}\\][ \\t]?{message}$".format(**{k: f"({v})" for k, v in _FIELDS.items()})
#: Exact numbers with a fraction.
EXACT = "decimal(28,9)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_index and value of the lines of a file, read split by split and numbered by where each split begins."""
    return with_row_index(spark.read.text(path)).select("row_index", "value")


def parse_log(lines: DataFrame) -> DataFrame:
    """row_index, level, month, day, time_of_day_us, thread, source, message. Other lines keep their text as message.

    The year is unknown, so the time of day stays a number and never becomes a timestamp.
    """
    def part(i: int) -> Column:
        return F.when(F.col("value").rlike(LOG), F.regexp_extract("value", LOG, i))

    us = ((part(4).cast("bigint") * 60 + part(5).cast("bigint")) * 60 + part(6).cast("bigint")) * 1_000_000 + F.rpad(part(7), 6, "0").cast("bigint")
    return lines.select(
        "row_index", part(1).alias("level"), part(2).cast("int").alias("month"), part(3).cast("int").alias("day"), us.alias("time_of_day_us"),
        part(8).cast("bigint").alias("thread"), part(9).alias("source"), F.coalesce(part(10), F.col("value")).alias("message"),
    )


def parse_timestamps(lines: DataFrame) -> DataFrame:
    """row_index and a column for each token of a list of equally wide lines that begin with a number.

    Accepted if 95 % of the non-empty lines have the most frequent number of tokens (ties: the larger one) and 90 % of those begin with
    a finite number; else there are no rows. Names and types are those of whole columns: the first is timestamp if all its values are
    finite and half of them reach 1e9 in size, else col_0; others are frame_index (whole numbers that rise from row to row), value
    (finite numbers), status (single letters) or col; a number beyond the second column's follows the name, as in value_3. Whole
    numbers stay exact longs, first columns with fractions exact decimals of nine digits, other numbers are doubles, the rest texts.
    A list of one column is accepted if that is a timestamp.
    """
    tokens = F.filter(F.split(F.trim("value"), r"[\s,;]+"), lambda x: x != "")
    rows = lines.select("row_index", tokens.alias("_k")).where(F.size("_k") > 0).select("row_index", "_k", F.size("_k").alias("_w"))
    widths = rows.groupBy("_w").agg(F.count("*").alias("n"))
    main = widths.agg(F.max(F.struct("n", "_w")).alias("m"), F.sum("n").alias("all")).first()
    none = lines.select("row_index", F.lit(None).cast("bigint").alias("timestamp")).where(F.lit(False))
    if main.m is None or main.m.n < 0.95 * main["all"]:
        return none
    kept = rows.where(F.col("_w") == main.m._w).select("row_index", "_k").withColumn("_one", F.lit(1))
    pairs = neighbours(kept, ["_one"], ["row_index"], {"_p": ("_k", -1)}, F.floor(F.col("row_index") / 100_000))
    each = pairs.select(F.posexplode(F.arrays_zip("_k", "_p")).alias("at", "t"))
    v, before = finite(F.col("t._k").try_cast("double")), finite(F.col("t._p").try_cast("double"))
    whole, exact = F.col("t._k").try_cast("bigint"), F.col("t._p").try_cast("bigint")
    rises = F.coalesce(whole > exact, v > before)
    told = each.groupBy("at").agg(
        F.count("*").alias("n"), F.count(v).alias("n_finite"), F.count_if(v == F.floor(v)).alias("n_whole"), F.count_if(F.coalesce(rises, F.lit(True))).alias("n_rising"),
        F.count_if(F.col("t._k").rlike(r"^\p{L}$")).alias("n_letters"), F.count(F.col("t._k").try_cast(EXACT)).alias("n_exact"),
        F.percentile_approx(F.abs(v), 0.5).alias("middle"),
    )
    told = {r["at"]: r for r in told.collect()}  # a row for each column
    first = told[0]
    clock = first.n_finite == first.n and first.middle >= 1e9
    if first.n_finite < 0.9 * first.n or (len(told) == 1 and not clock):
        return none
    columns, used = [], {"row_index"}
    for i in range(len(told)):
        r, token = told[i], F.get("_k", F.lit(i))
        number, integral = token.try_cast("double"), F.coalesce(token.try_cast("bigint"), token.try_cast("double").try_cast("bigint"))
        numeric, all_whole = r.n_finite == r.n, r.n_whole == r.n
        if i == 0:
            name = "timestamp" if clock else "col_0"
            value = integral if numeric and all_whole else token.try_cast(EXACT) if numeric and r.n_exact == r.n else number
        elif numeric:
            name = "frame_index" if all_whole and r.n > 2 and r.n_rising == r.n else "value"
            value = integral if name == "frame_index" else number
        else:
            name, value = ("status" if r.n_letters == r.n else "col"), token
        name = f"{name}_{i}" if name == "col" or (i > 1 and name != "status") or name in used else name
        used.add(name)
        columns.append(value.alias(name))
    return kept.select("row_index", *columns)


def grep(lines: DataFrame, keyword: str, around: int = 1, bucket: Column | None = None) -> DataFrame:
    """Lines that hold a keyword (ignoring case), and the lines next to them: row_index, value, is_match."""
    hit = lines.withColumn("_hit", F.contains(F.lower("value"), F.lit(keyword.lower()))).withColumn("_one", F.lit(1))
    near = neighbours(hit, ["_one"], ["row_index"], {"_b": ("_hit", -1), "_a": ("_hit", 1)} if around else {}, bucket)
    keep = F.col("_hit") | F.coalesce(F.col("_b"), F.lit(False)) | F.coalesce(F.col("_a"), F.lit(False)) if around else F.col("_hit")
    return near.where(keep).select("row_index", "value", F.col("_hit").alias("is_match"))


def read_excerpt(lines: DataFrame, start_line: int = 1, max_chars: int = 4_000) -> str:
    """Text from a line on, at most so many characters."""
    out, size = [], 0
    for row in lines.where(F.col("row_index") >= start_line - 1).orderBy("row_index").limit(max_chars).toLocalIterator():
        out.append(row.value)
        size += len(row.value) + 1
        if size >= max_chars:
            break
    return "\n".join(out)[:max_chars]
