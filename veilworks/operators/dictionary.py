"""Replacement dictionaries per document, their expansion, and the single-pass rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilworks.functions import patterns as P
from veilworks.functions.lineage import dealt
from veilworks.operators.detect import strip_suffix
from veilworks.sources.docx import transfer_case


def _b_label() -> Column:
    same = (F.col("a_name") != "") & (F.col("b_name") != "") & (F.col("a_label") == F.col("b_label"))
    renamed = F.when(F.col("a_label") == "Counterparty", F.concat("b_label", F.lit("-2"))).otherwise("Counterparty")
    return F.when(same, renamed).otherwise(F.col("b_label"))


def entry_array() -> Column:
    """The entries (placeholder, original) of configured() as an array in the row of a configuration."""
    entry = lambda label, name: F.struct(F.concat(F.lit("["), label, F.lit("]")).alias("placeholder"), name.alias("original"))
    none = F.array().cast("array<struct<placeholder:string,original:string>>")
    aliases = lambda c: F.coalesce(F.transform(c, lambda a: entry(a["label"], a["name"])), none)
    return F.concat(F.coalesce("additional", none), F.array(entry(F.col("a_label"), F.col("a_name")), entry(_b_label(), F.col("b_name"))), aliases(F.col("a_aliases")), aliases(F.col("b_aliases")))


def short_array() -> Column:
    """The short forms (original, placeholder) of short_forms() as an array in the row of a configuration."""
    part = lambda names, label: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("original"), F.concat(F.lit("["), label, F.lit("]")).alias("placeholder")))
    return F.concat(part(F.col("a_short"), F.col("a_label")), part(F.col("b_short"), _b_label()))


def collide(config: DataFrame) -> DataFrame:
    """Party B's label where both parties have the same one: Counterparty, or the label with -2."""
    return config.withColumn("b_label", _b_label())


def configured(config: DataFrame) -> DataFrame:
    """(doc_id, ord, placeholder, original): what a configuration names, in the order in which later entries win.

    config: doc_id, a_name, a_label, b_name, b_label, and arrays that may be null: additional (placeholder,
    original), a_aliases and b_aliases (name, label). Additional entries come first, then party A, party B
    under a label of its own, and the aliases of each."""
    rows = config.select("doc_id", F.posexplode(entry_array()).alias("ord", "e"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "e.placeholder", "e.original").filter("original <> ''")


def short_forms(config: DataFrame, inverse: DataFrame) -> DataFrame:
    """Replacements (doc_id, ord, original, placeholder) with the short forms that a configuration (a_short, b_short: arrays of
    names) gives its parties; they share their party's placeholder, what is there already stays, and the first wins."""
    rows = config.select("doc_id", F.posexplode(short_array()).alias("_i", "e"))
    new = rows.select("doc_id", "_i", "e.original", "e.placeholder").filter("original <> ''").join(dealt(inverse.select("doc_id", "original")), ["doc_id", "original"], "left_anti")
    new = new.groupBy("doc_id", "original").agg(F.min("_i").alias("_i"), F.min_by("placeholder", "_i").alias("placeholder"))
    return inverse.select("doc_id", "ord", "original", "placeholder").unionByName(new.select("doc_id", (F.col("_i") + 1_000_000).cast("long").alias("ord"), "original", "placeholder"))


def mapping(entries: DataFrame) -> DataFrame:
    """(doc_id, ord, placeholder, original): of entries with one placeholder the last wins, at the place of the first."""
    return entries.filter("original <> ''").groupBy("doc_id", "placeholder").agg(F.min("ord").alias("ord"), F.max_by("original", "ord").alias("original"))


def invert(mappings: DataFrame) -> DataFrame:
    """(doc_id, ord, original, placeholder): of placeholders with one original the last wins."""
    return mappings.groupBy("doc_id", "original").agg(F.min("ord").alias("ord"), F.max_by("placeholder", "ord").alias("placeholder"))


def suffix_forms(name: Column) -> Column:
    """The names that stripping one corporate suffix after another gives, longest first, without the name itself.

    A name of n words loses at least one with each suffix, so n steps reach the form that has none left."""
    def strip(forms: Column, _: Column) -> Column:
        return F.concat(forms, F.array(strip_suffix(F.element_at(forms, -1))))

    forms = F.aggregate(F.sequence(F.lit(1), F.size(F.split(name, r"(?U)\s+"))), F.array(name), strip)
    return F.filter(F.array_distinct(forms), lambda x: (x != "") & (x != name))


def expand_suffixes(replacements: DataFrame) -> DataFrame:
    """(doc_id, original, placeholder, ord, step, place): replacements and all their suffix-stripped forms.

    Nothing that is there is overwritten, the first comes first; place puts forms behind all that was there."""
    forms = F.concat(F.array("original"), F.coalesce(suffix_forms(F.col("original")), F.array().cast("array<string>")))
    every = replacements.select("doc_id", "ord", F.posexplode(forms).alias("_i", "original"), "placeholder").withColumn("step", F.col("_i") - 1)
    place = F.struct(F.when(F.col("step") < 0, 0).otherwise(1).alias("new"), F.col("ord").cast("long").alias("ord"), "step")
    return every.groupBy("doc_id", "original").agg(F.min_by("placeholder", place).alias("placeholder"), F.min(place).alias("place")).select("doc_id", "original", "placeholder", "place.ord", "place.step", "place")


def initialisms(name: Column) -> Column:
    """The initials of a name's significant words, and without the last word, of two letters or more."""
    words = F.filter(F.split(strip_suffix(name), r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(P.INITIALISM_STOP))
    full = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    shorter = F.when(F.size(words) > 2, F.substring(full, F.lit(1), F.length(full) - 1))
    return F.when(F.size(words) >= 2, F.filter(F.array(full, shorter), lambda x: x.isNotNull() & (F.length(x) >= 2))).otherwise(F.array().cast("array<string>"))


def found_initialisms(replacements: DataFrame, docs: DataFrame) -> DataFrame:
    """New entries (doc_id, original, placeholder, ord): initialisms of the names that the text holds in any case; the first name wins."""
    cand = replacements.select("doc_id", "ord", "placeholder", F.posexplode(initialisms(F.col("original"))).alias("step", "original"))
    cand = cand.join(dealt(replacements.select("doc_id", "original")), ["doc_id", "original"], "left_anti").join(dealt(docs.select("doc_id", F.upper("text").alias("_upper"))), "doc_id").filter(F.contains("_upper", "original"))
    return cand.groupBy("doc_id", "original").agg(F.min_by("placeholder", F.struct("ord", "step")).alias("placeholder"), F.min("ord").alias("ord"))


def phrases(words: Column) -> Column:
    """All contiguous runs of words shorter than the whole, by length and place."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.when(n > 1, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def whole_word(text: Column, part: Column) -> Column:
    return F.contains(text, part) & F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), part, F.lit(r"\E\b")))


def usable_part(part: Column) -> Column:
    """Long enough to stand for a name, and no month that is also a first name."""
    return (F.length(part) >= 3) & ~part.isin(P.MONTH_NAMES)


def _variants(replacements: DataFrame, docs: DataFrame, kind: str, words: Column, more: Column | None, keep, found) -> DataFrame:
    own = replacements.filter(F.col("placeholder").rlike(rf"^\[{kind}-\d+\]$")).withColumn("_w", words)
    forms = phrases(F.col("_w")) if more is None else F.array_distinct(F.concat(phrases(F.col("_w")), F.when(F.size("_w") > 1, F.array(more)).otherwise(F.array().cast("array<string>"))))
    cand = own.select("doc_id", "ord", "placeholder", F.posexplode(forms).alias("step", "original")).filter(keep(F.col("original")) & (F.length("original") >= 3))
    cand = cand.join(dealt(replacements.select("doc_id", "original")), ["doc_id", "original"], "left_anti").join(dealt(docs.select("doc_id", "text")), "doc_id").filter(found(F.col("text"), F.col("original")))
    first = F.struct("ord", "step")
    return cand.groupBy("doc_id", "original").agg(F.min_by("placeholder", first).alias("placeholder"), F.min(first).alias("place")).select("doc_id", "original", "placeholder", F.col("place.ord").alias("ord"), F.col("place.step").alias("step"))


def person_variants(replacements: DataFrame, docs: DataFrame) -> DataFrame:
    """New entries (doc_id, original, placeholder, ord, step): parts of [Person-n] names that the text uses as words."""
    words = F.filter(F.split("original", r"(?U)\s+"), lambda w: (w != "") & ~w.rlike(r"^[A-Z]\.?$"))
    first_last = F.concat_ws(" ", F.element_at(F.col("_w"), 1), F.element_at(F.col("_w"), -1))
    found = lambda text, x: whole_word(text, x) | whole_word(text, F.upper(x))
    return _variants(replacements, docs, "Person", words, first_last, usable_part, found)


def company_variants(replacements: DataFrame, docs: DataFrame) -> DataFrame:
    """New entries: parts of [Company-n] names that the text uses as words; generic single words are left out."""
    words = F.filter(F.split("original", r"(?U)\s+"), lambda w: w != "")
    return _variants(replacements, docs, "Company", words, None, lambda x: ~(~x.contains(" ") & F.lower(x).isin(P.COMPANY_STOP)), whole_word)


def split_lines(replacements: DataFrame) -> DataFrame:
    """(doc_id, original, placeholder, ord, step): keys of several lines become one key for each line, step its place; the first wins."""
    lines = replacements.select("doc_id", "ord", "placeholder", F.posexplode(F.split("original", "\n")).alias("step", "original"), F.col("original").contains("\n").alias("_cut"))
    lines = lines.withColumn("original", F.when(F.col("_cut"), F.trim("original")).otherwise(F.col("original"))).filter("original <> ''")
    first = F.struct("ord", "step")
    return lines.groupBy("doc_id", "original").agg(F.min_by("placeholder", first).alias("placeholder"), F.min(first).alias("f")).select("doc_id", "original", "placeholder", "f.ord", "f.step")


def short_placeholders(expanded: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every key that is no original of the mapping gets a placeholder of its own: [X-Short], [X-Short-2] and so on, without those the mapping has."""
    base = mappings.select("doc_id", "original", F.lit(True).alias("_base")).distinct()
    taken = mappings.groupBy("doc_id").agg(F.collect_set("placeholder").alias("_taken"))
    rows = expanded.join(dealt(base), ["doc_id", "original"], "left").join(dealt(taken), "doc_id", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<string>")))
    w = Window.partitionBy("doc_id", "placeholder", F.col("_base").isNull()).orderBy("ord", "step", "original")
    rows = rows.withColumn("_n", F.row_number().over(w))
    stem = F.concat(F.expr("substr(placeholder, 1, length(placeholder) - 1)"), F.lit("-Short"))
    names = F.transform(F.sequence(F.lit(1), F.col("_n") + F.size("_taken")), lambda i: F.concat(stem, F.when(i > 1, F.concat(F.lit("-"), i.cast("string"))).otherwise(""), F.lit("]")))
    short = F.element_at(F.filter(names, lambda x: ~F.array_contains("_taken", x)), F.col("_n"))
    return rows.select("doc_id", "original", F.when(F.col("_base"), F.col("placeholder")).otherwise(short).alias("placeholder"), "ord")


def dictionary(replacements: DataFrame) -> DataFrame:
    """One row for each document: a pattern of all keys, longest first, and the map from lower-cased key to replacement."""
    lower = replacements.groupBy("doc_id", F.lower("original").alias("k")).agg(F.max_by("placeholder", F.struct("ord", "original")).alias("v"), F.first("original").alias("original"))
    keys = F.array_sort(F.collect_list(F.struct((-F.length("k")).alias("n"), F.col("k").alias("k"), F.col("v").alias("v"))))
    return lower.groupBy("doc_id").agg(keys.alias("_keys")).select(
        "doc_id",
        F.concat(F.lit("(?iu)"), F.array_join(F.transform("_keys", lambda x: F.concat(F.lit(r"\Q"), x["k"], F.lit(r"\E"))), "|")).alias("pattern"),
        F.map_from_entries(F.transform("_keys", lambda x: F.struct(x["k"], x["v"]))).alias("lookup"),
    )


def cased(originals: Column, replacements: Column) -> Column:
    """Each replacement in the case of its original; both are arrays."""

    def each(a, b):
        return None if a is None else [transfer_case(x, y) for x, y in zip(a, b, strict=True)]

    return F.udf(each, "array<string>", useArrow=True)(originals, replacements)


def replace_all(docs: DataFrame, replacements: DataFrame, match_case: bool = False) -> DataFrame:
    """docs with text rewritten and the number of replacements (n_replaced); documents without entries stay.

    All matches are replaced at once, leftmost first, longest key first; what the map lacks stays. The
    pattern runs over a text twice: for what it matches, and for what lies between. match_case gives a
    replacement the case of what it replaces, which takes a worker's title-case rules."""
    d = docs.join(dealt(dictionary(replacements)), "doc_id", "left")
    cut = F.struct(F.split("text", F.col("pattern"), -1).alias("_between"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("_hits"))
    # a generator between the steps keeps the matches computed once
    d = d.select("*", F.inline(F.array(cut)))
    new = F.transform("_hits", lambda m: F.coalesce(F.try_element_at("lookup", F.lower(m)), m))
    if match_case:
        new = cased(F.col("_hits"), new)
    text = F.array_join(F.zip_with("_between", new, lambda s, m: F.concat(F.coalesce(s, F.lit("")), F.coalesce(m, F.lit("")))), "")
    known = F.col("pattern").isNotNull()
    d = d.withColumn("n_replaced", F.when(known, F.size("_hits")).otherwise(0).cast("long")).withColumn("text", F.when(known, text).otherwise(F.col("text")))
    return d.select(*docs.columns, "n_replaced")


def leaks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term) of forbidden terms, longer than two characters, that a text still holds."""
    return docs.join(dealt(terms.filter(F.length("term") > 2)), "doc_id").filter(F.contains(F.lower("text"), F.lower("term"))).select("doc_id", "term")


def restore_filename(name: Column, mappings: Column) -> Column:
    """A cloaked name with its originals back; mappings: array of (placeholder, original)."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_cloaked$", "")
    order = F.array_sort(F.transform(mappings, lambda m: F.struct((-F.length(m["placeholder"])).alias("n"), m["placeholder"].alias("placeholder"), m["original"].alias("original"))))
    return F.concat(F.aggregate(order, stem, lambda acc, m: F.replace(acc, m["placeholder"], m["original"])), F.lit("_uncloaked.docx"))


def clean_filename(name: Column, replacements: Column) -> Column:
    """Names in a file name by their placeholders; blanks match any separator; replacements: array of (original, placeholder)."""
    both = F.flatten(F.transform(replacements, lambda r: F.array(F.struct(r["original"].alias("o"), r["placeholder"].alias("p")), F.struct(strip_suffix(r["original"]).alias("o"), r["placeholder"].alias("p")))))
    order = F.array_sort(F.filter(F.transform(both, lambda r: F.struct((-F.length(r["o"])).alias("n"), r["o"].alias("o"), r["p"].alias("p"))), lambda r: r["o"] != ""))
    pattern = lambda o: F.concat(F.lit("(?iu)"), F.lit(r"\Q"), F.replace(o, F.lit(" "), F.lit(r"\E[\s_\-.]?\Q")), F.lit(r"\E"))
    return F.aggregate(order, name, lambda acc, r: F.regexp_replace(acc, pattern(r["o"]), r["p"]))
