"""Secret scan with linking of multipart credentials, in DataFrame functions only.

Regular expressions find parts; ``split`` by the same pattern gives the text between them, so running sums of lengths are
the positions. Labelled secrets, access keys and long hex runs are reported as they stand. Weak parts (identifiers, opaque
strings, endpoints) are reported only where complementary parts co-occur in one scope (the text between two blank lines):
an interval join of parts with scopes, as a sweep over both in the order of their positions, and a join of each scope's
parts with what else the scope holds. Parts may overlap or contain one another, as a key inside an endpoint's url does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unpacked, whole_rows

#: Code points of a text that redaction reads at once.
CHUNK = 4_096

#: kind: pattern, value group, a pattern the value must hold, a cheap test of the whole text.
#: The first three are base kinds, in their order.
PARTS: dict[str, tuple[str, int, str, str]] = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, r"^.{6}", r"(?i:passw|secret|token|api_?key)",
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, r"^.{20}", r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, r"^", r"[0-9a-f]{24}"),
    "identifier": (
        r"""((?i:client_?id|access_?key_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
        2, r"^.{3}", r"(?i:client_?id|access_?key_?id|user_?name|login)",
    ),
    "opaque": (r"[A-Za-z0-9+/]{40,}", 0, r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])", r"[A-Za-z0-9+/]{40}"),
    "endpoint": (r"""[a-z][a-z0-9+]{1,15}://[^\x09-\x0D\x20"'<>]+""", 0, r"^", r"://"),
}
BASE = ("assign", "access", "hex")
SECRET, PARTNER = ("assign", "hex", "opaque"), ("access", "identifier", "endpoint")
BREAK = r"\n[\x20\t]*\n"


def _found(text: Column, kind: str) -> Column:
    """Matches in order: (characters since the last match, characters of the match, whether its value is good)."""
    pattern, group, good, _ = PARTS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    return F.transform(
        F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v")),
        lambda m: F.struct(
            F.lit(kind).alias("kind"), F.length(m["b"]).cast("bigint").alias("before"),
            F.length(m["w"]).cast("bigint").alias("size"), m["v"].rlike(good).alias("good"),
        ),
    )


def _breaks(text: Column) -> Column:
    pieces = F.split(text, BREAK, -1)
    marks = F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(marks)).alias("b"), marks.alias("w")),
        lambda m: F.struct(
            F.lit("break").alias("kind"), F.length(m["b"]).cast("bigint").alias("before"),
            F.length(m["w"]).cast("bigint").alias("size"), F.lit(True).alias("good"),
        ),
    )


def _candidates(text: Column) -> tuple[dict[str, Column], Column]:
    """Cheap tests for each kind, and for a text that may have a span: a base kind, or weak parts of both sides."""
    has = {kind: text.rlike(PARTS[kind][3]) for kind in PARTS}
    linkable = F.coalesce((has["assign"] | has["hex"] | has["opaque"]) & (has["access"] | has["identifier"] | has["endpoint"]), F.lit(False))
    return has | {"linkable": linkable}, has["assign"] | has["access"] | has["hex"] | linkable


def _parts(text: Column) -> Column:
    """All parts that may become spans, kind by kind, as (kind, before, size, good)."""
    none = F.array().cast("array<struct<kind:string,before:bigint,size:bigint,good:boolean>>")
    has, _ = _candidates(text)
    base = [F.when(has[k], _found(text, k)).otherwise(none) for k in BASE]
    weak = [F.when(has[k], _found(text, k)).otherwise(none) for k in PARTS if k not in BASE]
    return F.concat(*base, F.when(has["linkable"], F.concat(*weak, _breaks(text))).otherwise(none))


def _placed(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, scope) of all good parts; positions in code points, end exclusive."""
    each = rows.where(F.size("parts") > 0).select("row", F.posexplode("parts").alias("n", "p")).select("row", "n", "p.*")
    order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = each.select("row", "kind", "good", "size", F.sum(F.col("before") + F.col("size")).over(order).alias("end"))
    at = at.where("good").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scope = F.sum((F.col("kind") == "break").cast("int")).over(before)
    return at.withColumn("scope", scope).where("kind <> 'break'")


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts whose scope holds a part of the other side: never pairs, so the work grows with the number of parts."""
    sides = parts.groupBy("row", "scope").agg(F.bool_or(F.col("kind").isin(*SECRET)).alias("secret"), F.bool_or(F.col("kind").isin(*PARTNER)).alias("partner"))
    whole = sides.where("secret and partner").select("row", "scope")
    return parts.where(~F.col("kind").isin(*BASE)).join(whole, ["row", "scope"]).select("row", "kind", "start", "end")


def _spans(rows: DataFrame) -> DataFrame:
    """(row, spans) of the rows (row, parts) that have any: sorted (start, rank, kind, end)."""
    parts = staged(_placed(rows), "secret-places")
    kept = parts.where(F.col("kind").isin(*BASE)).select("row", "kind", "start", "end").union(_linked(parts))
    rank = F.array_position(F.array(*map(F.lit, PARTS)), F.col("kind"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id and two sorted arrays of (start, rank, kind, end): base and spans.

    A null text counts as empty. Repeated rows and null doc_ids each keep their own row. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # read from the text in one pass and written to the shared folder without the text
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), _parts(text).alias("parts")), "secret-parts")
    none = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
    spans = F.coalesce("spans", none)
    return rows.select("row", "doc_id").join(_spans(rows.select("row", "parts")), "row", "left").select(
        "doc_id", F.filter(spans, lambda s: s["rank"] <= len(BASE)).alias("base"), spans.alias("spans")
    )


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _cut(chunks: Column, begin: Column, end: Column) -> Column:
    """Characters begin to end of a text that is held as chunks of CHUNK code points; only the chunks between are read."""
    first, last = F.floor(begin / CHUNK), F.floor((end - 1) / CHUNK)
    between = F.array_join(F.slice(chunks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.when(end > begin, F.substring(between, (begin - first * CHUNK + 1).cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    All columns stay, whatever their names; n_chars, where there is one, is counted anew for texts that change. Null texts
    stay null, and repeated rows stay. Only texts that may hold a span are staged and shuffled; all others pass through.
    The work grows with a text's length and its number of spans, not with their product.
    """
    whole, column = whole_rows(docs)
    text = F.coalesce(column["text"].cast("string"), F.lit(""))
    touched = staged(docs.where(_candidates(text)[1]).select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), "secret-texts")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    found = _spans(staged(touched.select("row", _parts(text).alias("parts")), "secret-parts"))
    earlier = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("row", F.posexplode("spans").alias("n", "s")).select("row", "n", "s.*")
    each = each.withColumn("done", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("bigint")))
    marks = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("done"), F.struct("start", "done", "kind"))))
    merged = each.groupBy("row").agg(marks.alias("marks"), F.max("end").alias("last"))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    joined = touched.join(merged, "row", "left").withColumn("chunks", F.when(F.col("marks").isNotNull(), chunks))
    shown = F.transform("marks", lambda m: F.concat(_cut(F.col("chunks"), m["done"], m["start"]), F.lit("["), m["kind"], F.lit("]")))
    changed = F.concat(F.array_join(shown, ""), _cut(F.col("chunks"), F.col("last"), F.length(text).cast("bigint")))
    joined = joined.withColumn("clean", F.when(F.col("marks").isNotNull(), changed).otherwise(F.col("doc.text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        count = F.when(F.col("marks").isNotNull(), F.length("clean")).otherwise(F.col("doc.n_chars"))
        new["n_chars"] = count.cast(docs.schema["n_chars"].dataType)
    rest = docs.where(~_candidates(F.coalesce(column["text"].cast("string"), F.lit("")))[1])
    return unpacked(joined, "doc", docs.columns, **new).union(rest)
