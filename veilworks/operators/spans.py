"""From model scores to entity spans: words, span enumeration, decoding and greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.functions import patterns as P

WORD = r"(?U)\w+(?:[-_]\w+)*|\S"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def span_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, end, valid) of all spans of up to `width` tokens from (doc_id, n)."""
    starts = docs.filter("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("start"))
    return starts.select("doc_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias("end"), "n").select("doc_id", "start", "end", (F.col("end") < F.col("n")).alias("valid"))


def sigmoid(x: Column) -> Column:
    return (1.0 / (1.0 + F.exp(-x.cast("double")))).cast("float")


def decode(logits: DataFrame, threshold: float) -> DataFrame:
    """Candidates from (doc_id, n, start, k, label, logit): probability above the threshold, end within the text."""
    scored = logits.select("doc_id", "start", (F.col("start") + F.col("k")).alias("end"), "label", sigmoid(F.col("logit")).alias("score"), "n")
    return scored.filter((F.col("score").cast("double") > threshold) & (F.col("end") < F.col("n"))).drop("n")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def overlapping(candidates: DataFrame) -> DataFrame:
    """(doc_id, a_start, a_end, b_start, b_end): the pairs of a document's spans that overlap, the earlier first; spans of one start are no pair."""
    span = lambda p: F.struct(F.col("start"), F.col("end")).alias(p)
    pairs = candidates.select("doc_id", span("a")).join(candidates.select("doc_id", span("b")), "doc_id").filter((F.col("a.start") < F.col("b.start")) & overlaps(F.col("a"), F.col("b")))
    return pairs.select("doc_id", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("start", "end")])


def greedy(candidates: DataFrame) -> DataFrame:
    """The highest-scoring spans that do not overlap, by document; ties go to the earlier span."""
    item = F.struct((-F.col("score")).alias("neg"), "start", "end", "label", "score")
    ordered = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    none = F.filter("c", lambda x: F.lit(False))
    kept = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return ordered.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.score")


def by_label_threshold(spans: DataFrame) -> DataFrame:
    """Spans at or above their label's threshold, with the entity type of the label."""
    pairs = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    least = F.element_at(pairs(P.NER_THRESHOLDS), F.col("label"))
    return spans.filter(F.col("score").cast("double") >= least).withColumn("entity_type", F.element_at(pairs(P.NER_LABELS), F.col("label")))


def accept(text: Column, kind: Column) -> Column:
    """The cleaned entity text, or null where a model's entity is none."""
    t = F.trim(text)
    person = F.when(~F.lower(t).isin(P.NER_PERSON_BLOCK) & ~t.rlike(r"^\p{Ll}"), t)
    c = F.trim(F.regexp_replace(t, P.FLAGS + P.NER_DETERMINER, ""))
    tokens = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    has = lambda words, of: F.arrays_overlap(of, F.array(*[F.lit(w) for w in words]))
    bare = F.regexp_replace(c, "[.,;:]+$", "")
    shout = (bare == F.upper(bare)) & (bare != F.lower(bare)) & F.length(bare).between(2, 5) & ~F.lower(bare).isin(P.SUFFIX_WORDS)
    first, last = F.lower(F.regexp_extract(c, r"^(\S+)", 1)), F.lower(F.regexp_replace(F.regexp_extract(c, r"(\S+)$", 1), "[.,;:]+$", ""))
    refuse = first.isin(P.LEGAL_ROLES) | has(P.INSTITUTIONS, F.transform(tokens, F.lower)) | last.isin(P.STATUTE_WORDS) | has(P.LEGAL_ABBREVIATIONS, tokens) | shout
    company = F.when((c != "") & ~refuse, c)
    address = F.when(~F.lower(t).isin(P.ADDRESS_BLOCK) & t.rlike(r"\d"), t)
    by_kind = F.when(kind == "PERSON", person).when(kind == "COMPANY", company).when(kind == "ADDRESS", address).otherwise(t)
    return F.when(~text.contains("\n") & (t != ""), by_kind)


def words_mask(word_ids: Column, prompt: Column) -> Column:
    """For each sub-word its 1-based text word if it is the word's first, else 0; the first `prompt` words are 0."""
    zero = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = x.isNotNull() & ~x.eqNullSafe(acc["prev"])
        seen = acc["seen"] + F.when(new, 1).otherwise(0)
        value = F.when(new & (seen > prompt), seen - prompt).otherwise(0)
        return F.struct(x.alias("prev"), seen.alias("seen"), F.concat(acc["out"], F.array(value)).alias("out"))

    return F.aggregate(word_ids, zero, step, lambda acc: acc["out"])
