"""How the work is dealt out: what the plans hold, and the patterns of java.util.regex against the fixed values."""

import random

import pytest
from pyspark.sql import functions as F

from veilworks.functions import patterns as P
from veilworks.operators import cloak, detect, dictionary
from veilworks.plans.registry import QUERIES
from veilworks.sources import docx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_detection_deals_out_once(spark):
    d = docs(spark, "Call 555-123-4567")
    for df in (detect.detect_regex(d), detect.deduplicated(d), detect.typed(d), detect.detect(d)):
        assert plan(df).count("Exchange hashpartitioning") == 1 and "Window" not in plan(df) and "Aggregate" not in plan(df)
    assert "Join" not in plan(detect.detect(d, detect.parties(d)))


@pytest.mark.parametrize("kind", ["a2", "rewrite", "leaks", "variants", "edit"])
def test_texts_are_not_broadcast(spark, data, kind):
    """The planner takes made texts and files for a few bytes a row; they must not pass through the driver."""
    d = docs(spark, "Ann Lee met Acme Trust LLC")
    keys = spark.createDataFrame([(0, 1, "Ann Lee", "[Person-1]"), (0, 2, "Acme Trust LLC", "[Company-1]")], "doc_id long, ord long, original string, placeholder string")
    files = spark.createDataFrame([("a.docx", b"x")], "path string, content binary")
    maps = files.select("path", F.create_map(F.lit("a"), F.lit("b")).alias("lookup"))
    df = {
        "a2": lambda: docx.listed(files.select("path"), files), "rewrite": lambda: dictionary.replace_all(d, keys), "leaks": lambda: dictionary.leaks(d, keys.select("doc_id", F.col("original").alias("term"))),
        "variants": lambda: dictionary.person_variants(keys, d).unionByName(dictionary.company_variants(keys, d)), "edit": lambda: cloak.edit_files(files, maps, maps.withColumnRenamed("lookup", "authors"), "keep", False, False),
    }[kind]()
    assert "Broadcast" not in plan(df)


def test_expansion_reads_its_rows_once(spark, data):
    assert "Union" not in plan(QUERIES["k3_suffix_expansion"](spark, data))


def test_rows_of_one_document(spark):
    """Matches of rows that share an id count together; rows without an id are one document, which no party is taken from."""
    d = spark.createDataFrame([(1, "$100 and a@b.io"), (1, "$100, Acme LLC"), (None, "ACME LLC, Acme LLC"), (None, "$5")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["count"], r["placeholder"]) for r in detect.detect(d, detect.parties(d)).collect())
    assert got == [(0, "$5", 1, "[Amount-1]"), (0, "ACME LLC", 2, "[Company-1]"), (1, "$100", 2, "[Amount-1]"), (1, "Acme LLC", 1, "[Company-1]"), (1, "a@b.io", 1, "[Email-1]")]


PIECES = [
    "Acme", "ACME", "Éclat", "O'Neil", "services", "Services", "Group", "LLC", "L.L.C.", "Co", "County", "Bank", "agreement", "Agreement", "License", "Dear", "The", " ", " ", "  ", "\n", ",", ", ", ".", "(", "(the ", "\"", "”", "“",
    "hereinafter ", "referred to as ", "Vendor", "x", "3", "12", "123", "4567", "1234567", "-", "/", "$", "@", "a.b", "www.", "http://", "https://", "com", "org", "exceed", "total of", "up to", "shares", "Main", "Oak Street", "St", "Suite", "Salem",
    "Oregon", "OR", "97301", "May", "March 5", "2020", "in", "near", "and", "between", "as Agent", "/s/", "___", "Name: ", "Jane Roe", "K", "K", "ſ", "é", "_", "é3",
]


def test_java_patterns_match_what_the_fixed_values_match(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    d = docs(spark, *texts)
    column = lambda p, g: F.regexp_extract_all("text", F.lit(P.FLAGS + p), F.lit(g))
    for old, new in P.JAVA.items():
        wrong = d.select("text", column(old, 0).alias("a"), column(new, 0).alias("b")).filter("a <> b").first()
        assert wrong is None, (old[:40], wrong)


def test_only_suffix(spark):
    d = docs(spark, "LLC", " , Inc.", "Acme LLC", "Bank Trust", "", "  ", "Co.\n", "\nCo", "Group, LLC", "lLc.  ", "  Ltd")
    plain = F.trim(F.regexp_replace("text", P.FLAGS + P.BARE_SUFFIX, "")) == ""
    assert [r["text"] for r in d.filter(plain != detect.only_suffix(F.col("text"))).collect()] == []


def test_names_and_their_tails_in_one_search(spark):
    """P.COMPANY_KEPT and P.PARTY against a search for names, a search for what follows, and conditions on both."""
    rng = random.Random(6)
    pieces = [x for x in PIECES if not any(c.isdigit() for c in x)] + ['("Vendor")', ' (the "Seller,"', "Acme LLC"] * 4
    d = docs(spark, *["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 24))) for _ in range(4000)])
    column = lambda p, g: F.regexp_extract_all("text", F.lit(P.FLAGS + p), F.lit(g))
    shape = P.COMPANY + r"(?=([\s\S]{0,2000}))"
    pairs = F.arrays_zip(column(shape, 1).alias("n"), column(shape, 2).alias("t"))
    fit = F.filter(pairs, lambda m: ~detect.in_longer_word(m["t"]) & ~detect.before_agreement(m["t"]))
    named = F.filter(fit, lambda m: m["t"].rlike("(?Ud)" + P.LABEL_AFTER))
    part = lambda g: F.transform(F.filter(column(P.PARTY, 2), lambda m: m != ""), lambda m: F.regexp_extract(m, P.FLAGS + P.PARTY_PARTS, g))
    got = d.select(
        "text", F.transform(fit, lambda m: m["n"]).alias("a"), F.filter(column(P.COMPANY_KEPT, 2), lambda m: m != "").alias("b"),
        F.transform(named, lambda m: m["n"]).alias("c"), part(1).alias("d"), F.transform(named, lambda m: F.regexp_extract(m["t"], "(?Ud)" + P.LABEL_AFTER, 1)).alias("e"), part(2).alias("f"),
    )
    rows = got.collect()
    assert sum(len(r["a"]) for r in rows) > 500 and sum(len(r["c"]) for r in rows) > 30
    assert [r for r in rows if r["a"] != r["b"] or r["c"] != r["d"] or r["e"] != r["f"]] == []
