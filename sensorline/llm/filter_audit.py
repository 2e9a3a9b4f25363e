"""Interaction audit of text filters: what each filter removes, at each place of every order, as windows over long rows.

A document becomes a mask of the filters it fails. Masks are counted once a part; each mask cell is then unpivoted against the
steps of every order, a running bit-or over the steps before tells what was failed earlier, and conditional sums give the
metrics. What is counted after the masks has a fixed size a part, whatever the number of documents.

The identity filter needs no text in a shuffle: documents are compared by SHA-256 of their texts, and rows that agree are counted
before they move, so that a group of copies of any size is a few rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: White space between words, as a class of a pattern and as a set of characters.
SPACE, SPACES = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\f\r"
MARKS = "[#$%&*|]"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, least_words: int = 200, distinct_share: int = 50, upper_share: int = 3) -> dict[str, Column]:
    """Conditions under which a text (not null) fails: A too few words, B too few distinct words, C too many A-Z, D marks.

    Shares are in hundredths. An empty text has no words: it fails A alone.
    """
    inner = F.btrim(text, F.lit(SPACES))
    words, empty = F.split(inner, SPACE), inner == ""
    n = F.when(empty, 0).otherwise(F.size(words))
    distinct = F.when(empty, 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < least_words,
        "B": 100 * distinct.cast("bigint") < distinct_share * n.cast("bigint"),
        "C": 100 * upper.cast("bigint") > upper_share * F.length(text).cast("bigint"),
        "D": text.rlike(MARKS),
    }


def masks(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """One row for each part and mask: part, mask (bit i: fails filter i of LETTERS), n, good, toxic (counts of documents).

    E fails where a smaller doc_id has the same text, wherever it stands; repeated rows of the smallest doc_id do not fail. A null
    text is empty, a null lang the part ''. Rows without doc_id have no smaller one, are none, and have no labels. A document counts
    as good (toxic) if any row of labels says so; other rows of labels are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part.alias("part"), text.alias("text"))
    failed = text_failures(F.col("text"))
    mask = sum((F.when(failed[c], 1 << i).otherwise(0) for i, c in enumerate(LETTERS) if c in failed), F.lit(0))
    # documents without an id need no identity: they are counted before anything moves
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256)))
    ids = rows.select("doc_id", "part", mask.alias("mask"), digest.alias("digest")).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    told = told.where("good = 1 or toxic = 1")
    known = ids.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    same = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    kept = F.when(F.col("digest").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = same.withColumn("first", first).withColumn("n_kept", kept).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("n_kept").alias("n")),
            F.struct((F.col("mask") + F.lit(1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - F.col("n_kept")).alias("n")),
        )).alias("c"),
    )
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")
    )


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every part, order of the filters and step: part, filter_order, step, METRICS and shapley, zeros included.

    cells: part, mask, n, good, toxic. Of the step's filter: kept documents fail neither it nor an earlier one; removed ones fail it
    first; redundant ones fail it after an earlier one; unique_fails fail nothing else; good_lost and toxic_lost are removed ones
    with that label; shapley sums removed over all orders. All are counts (long).
    """
    orders = ["".join(p) for p in permutations(letters)]
    steps = range(1, len(letters) + 1)
    wide = cells.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    wide = wide.select("*", *[F.substring("filter_order", k, 1).alias(str(k)) for k in steps])
    long = wide.unpivot(["part", "mask", "n", "good", "toxic", "filter_order"], [str(k) for k in steps], "step", "letter")
    # one shuffle serves the running windows and the sums
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(letters))]), F.instr(F.lit(letters), F.col("letter")))
    long = long.withColumns({"step": F.col("step").cast("int"), "bit": bit}).repartition("part", "filter_order")
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    rows = long.withColumn("own", fails).withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    now, late, single = F.col("own") != 0, F.col("earlier") != 0, F.col("mask") == F.col("bit")

    def total(when: Column, value: str = "n") -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0))

    sums = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(~now & ~late).alias("kept"), total(now & ~late).alias("removed"), total(now & late).alias("redundant"), total(single).alias("unique_fails"),
        total(now & ~late, "good").alias("good_lost"), total(now & ~late, "toxic").alias("toxic_lost"),
    )
    by_filter = Window.partitionBy("part", "letter")  # a row for each order
    return sums.select("part", "filter_order", "step", *METRICS, F.sum("removed").over(by_filter).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """``interactions`` of the five filters over whole texts, by lang unless another column is named. No documents, no rows."""
    return interactions(masks(docs, labels, part))
