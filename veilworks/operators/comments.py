"""Comments, their authors and the metadata of documents as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilworks.functions.lineage import dealt
from veilworks.operators.security import COMMENT, COMMENTS_SHOWN, shortened

KEEP, STRIP, SANITIZE = "keep", "strip", "sanitize"


def initials(label: Column) -> Column:
    """The first letter of each word in capitals."""
    return F.array_join(F.transform(F.filter(F.split(label, r"(?U)\s+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def reviewer_label(index: Column) -> Column:
    """Reviewer A to Z, then AA, AB and so on, from an index that starts at 0."""
    letter = lambda i: F.char(F.lit(65).cast("long") + i)
    two = F.concat(letter(F.floor(index / 26) - 1), letter(index % 26))
    return F.concat(F.lit("Reviewer "), F.when(index < 26, letter(index)).otherwise(two))


def authors(comments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, author, n, initials, label) from (doc_id, idx, author, text): labels in order of first comments.

    known (doc_id, author, label) fixes labels, of authors that may have no comment; the others' labels then
    start behind as many letters as the document has such entries."""
    per = comments.filter("author <> ''").groupBy("doc_id", "author").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    if known is None:
        per = per.withColumns({"_label": F.lit(None).cast("string"), "_entries": F.lit(0).cast("long")})
    else:
        per = per.join(known.select("doc_id", "author", F.col("label").alias("_label")), ["doc_id", "author"], "left")
        per = per.join(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_entries")), "doc_id", "left").withColumn("_entries", F.coalesce("_entries", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("_label").isNull()).orderBy("first_idx")) - 1
    label = F.coalesce("_label", reviewer_label(place.cast("long") + F.col("_entries")))
    return per.select("doc_id", "author", "n", initials(F.col("author")).alias("initials"), label.alias("label"))


def counts(comments: DataFrame) -> DataFrame:
    """(doc_id, n): the comments of each document."""
    return comments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def first_shown(comments: DataFrame, n: int = COMMENTS_SHOWN, limit: int = COMMENT) -> DataFrame:
    """(doc_id, idx, author, text): the first n comments of each document, with shortened texts, as a report shows them."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return comments.withColumn("_n", place).filter(F.col("_n") <= n).select("doc_id", "idx", "author", shortened(F.col("text"), limit).alias("text"))


def process(comments: DataFrame, mode: str, known: DataFrame | None = None) -> DataFrame:
    """Comments kept, dropped, or with authors by their labels and fitting initials."""
    if mode == STRIP:
        return comments.limit(0)
    if mode == KEEP:
        return comments
    named = comments.join(dealt(authors(comments, known).select("doc_id", "author", "label")), ["doc_id", "author"], "left")
    return named.select("doc_id", "idx", F.coalesce("label", "author").alias("author"), initials(F.coalesce("label", "author")).alias("initials"), "text")


def restore(sanitised: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sanitised comments with the authors that mapping (doc_id, author, label) has for their labels."""
    back = mapping.select("doc_id", F.col("label").alias("author"), F.col("author").alias("_was"))
    return sanitised.join(dealt(back), ["doc_id", "author"], "left").select("doc_id", "idx", F.coalesce("_was", "author").alias("author"), initials(F.coalesce("_was", "author")).alias("initials"), "text")


def escape_xml(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def strip_anchors(xml: Column) -> Column:
    """document.xml without the three kinds of comment markers."""
    for pattern in (r"(?s)<w:commentRangeStart\b[^>]*/>", r"(?s)<w:commentRangeEnd\b[^>]*/>", r"(?s)<w:commentReference\b[^>]*/>"):
        xml = F.regexp_replace(xml, pattern, "")
    return xml


def clean_core(metadata: DataFrame) -> DataFrame:
    """Core properties with people, history and description blank; title, subject, keywords and category stay."""
    blank, fixed = F.lit(""), "2020-01-01T00:00:00Z"
    return metadata.withColumns({"creator": blank, "last_modified_by": blank, "description": blank, "revision": F.lit("1"), "created": F.lit(fixed), "modified": F.lit(fixed), "last_printed": F.lit(None).cast("string")})


def clean_app(metadata: DataFrame) -> DataFrame:
    """Application properties with company and manager blank and a common application and template."""
    return metadata.withColumns({"company": F.lit(""), "manager": F.lit(""), "application": F.lit("Microsoft Office Word"), "template": F.lit("Normal.dotm")})
