"""Whole files cloaked and restored: text, comments, metadata, and the mapping that leads back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.functions.lineage import dealt, folded
from veilworks.operators import comments, detect, planning, security
from veilworks.operators import dictionary as K
from veilworks.sources import docx


class Plan(NamedTuple):
    """What a document's cloaking does: keys (doc_id, original, placeholder, ord), all with placeholders of their own;
    mapping (doc_id, ord, placeholder, original) that leads back; names (doc_id, name) of the cloaked files."""

    keys: DataFrame
    mapping: DataFrame
    names: DataFrame


class Cloaked(NamedTuple):
    """files (path, name, content, n_replaced, error); mapping (path, original, placeholder); authors (path, author, label);
    findings of the security scan, by path."""

    files: DataFrame
    mapping: DataFrame
    authors: DataFrame
    findings: DataFrame


def carrying(docs: DataFrame, entries: DataFrame | None = None, config: DataFrame | None = None) -> DataFrame:
    """docs with what their cloaking starts from, as arrays in their rows: _placeholders and _originals of the entries, _shorts and _labels of short forms.

    Entries (doc_id, ord, placeholder, original) or a configuration by doc_id meet the docs in a join; docs that
    carry the columns of a configuration need none."""
    part = lambda c, name, alias: F.transform(c, lambda e: e[name]).alias(alias)
    none = F.array().cast("array<struct<original:string,placeholder:string>>")
    kept = [c for c in docs.columns if c not in CONFIG and c != "_parties"]
    if config is not None:
        docs = docs.select(*kept).join(dealt(config.select("doc_id", *CONFIG)), "doc_id", "left")
    carries = "a_name" in docs.columns
    given, shorts = (K.entry_array() if carries else None), (K.short_array() if carries else none)
    if entries is not None:
        rows = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "placeholder", "original"))).alias("_given"))
        docs, given = docs.join(dealt(rows), "doc_id", "left"), F.col("_given")
    elif not carries:
        docs, given = docs.withColumn("_given", F.transform("_parties", lambda p: F.struct(p["name"].alias("original"), F.concat(F.lit("["), p["label"], F.lit("]")).alias("placeholder"))) if "_parties" in docs.columns else none), F.col("_given")
    docs = docs.select(*kept, given.alias("_g"), shorts.alias("_s"))
    return docs.select(*kept, part("_g", "placeholder", "_placeholders"), part("_g", "original", "_originals"), part("_s", "original", "_shorts"), part("_s", "placeholder", "_labels"))


CONFIG = ["a_name", "a_label", "b_name", "b_label", "additional", "a_aliases", "b_aliases", "a_short", "b_short"]
#: The columns of carrying() that steps_of() takes.
CARRIED = ["_placeholders", "_originals", "_shorts", "_labels"]


def steps_of(text: str | None, placeholders, originals, shorts, labels) -> planning.Steps:
    return planning.worked_out(list(zip(placeholders or (), originals or (), strict=True)), list(zip(shorts or (), labels or (), strict=True)), text)


def plan(docs: DataFrame, entries: DataFrame | None = None, config: DataFrame | None = None) -> Plan:
    """How docs (doc_id, name, text), one row a document, are cloaked by entries (doc_id, ord, placeholder, original), and by the short forms of a configuration.

    In this order: suffix-stripped forms, one key for each line, parts of person and company names that the
    text uses; then the file names, in which forms share their name's placeholder; then a placeholder for each form.
    All of it is worked out within the rows of docs."""
    rows = carrying(docs, entries, config)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys(i, text, *given):
        return [(i, original, placeholder, n) for n, (original, placeholder) in enumerate(steps_of(text, *given).keys, 1)]

    def mapping(i, text, *given):
        return [(i, *m) for m in steps_of(text, *given).mapping]

    def names(i, name, text, *given):
        return [(i, planning.clean_name(name, steps_of(text, *given).known))]

    return Plan(
        folded(rows, ["doc_id", "text", *CARRIED], f"doc_id {kind}, original string, placeholder string, ord long", keys),
        folded(rows, ["doc_id", "text", *CARRIED], f"doc_id {kind}, ord long, placeholder string, original string", mapping),
        folded(rows, ["doc_id", "name", "text", *CARRIED], f"doc_id {kind}, name string", names),
    )


def cloak_documents(docs: DataFrame, entries: DataFrame | None = None, config: DataFrame | None = None) -> tuple[DataFrame, Plan]:
    """(doc_id, name, text, n_replaced) of docs (doc_id, name, text) cloaked, and the plan; entries come from the configuration unless given.

    One row is one document, and is cloaked where it is read. Docs may carry the columns of their configuration themselves."""
    rows = carrying(docs, entries, config)

    def run(i, name, text, *given):
        steps = steps_of(text, *given)
        new, n = (text, 0) if text is None else planning.Rewriter(steps.keys)(text)
        return [(i, planning.clean_name(name, steps.known), new, n)]

    out = folded(rows, ["doc_id", "name", "text", *CARRIED], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string, text string, n_replaced long", run)
    return out, plan(docs, entries, config)


def as_map(rows: DataFrame, key: str, value: str, name: str, order: str | None = None) -> DataFrame:
    """(path, map of key to value) from rows of a file, in order of `order` or of the keys; keys are distinct within it."""
    entries = F.sort_array(F.collect_list(F.struct(*([order] if order else []), F.col(key).alias("_k"), F.col(value).alias("_v"))))
    return rows.filter(F.col(key).isNotNull()).groupBy("path").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["_k"], e["_v"]))).alias(name))


def edit_files(files: DataFrame, lookups: DataFrame, authors: DataFrame, mode: str, comment_text: bool, strip: bool) -> DataFrame:
    """(path, content, n_replaced, error): each file opened by one worker call for all that changes in it.

    lookups (path, lookup map, and for comments words map, if there is one) and authors (path, authors map) meet first, so contents are joined once."""
    plan = lookups.join(authors, "path", "full_outer")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content, lookup, people, words in zip(f["path"], f["content"], f["lookup"], f["authors"], f["words"], strict=True):
                lookup = dict(lookup or {})
                try:
                    words = planning.Rewriter((dict(words or {}) or lookup).items()) if comment_text else None
                    rows.append((path, *docx.edited(bytes(content), planning.Rewriter(lookup.items()), mode, dict(people or {}), words, strip), None))
                except Exception as e:  # a broken file must not end the job: it is reported as a row
                    rows.append((path, None, 0, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "content", "n_replaced", "error"])

    if "words" not in lookups.columns:
        plan = plan.withColumn("words", F.lit(None).cast("map<string,string>"))
    joined = files.select("path", "content").join(dealt(plan), "path", "left").select("path", "content", "lookup", "authors", "words")
    return joined.mapInPandas(run, "path string, content binary, n_replaced long, error string")


def reviewers(people: list[str]) -> list[tuple[str, str]]:
    """(author, label) of a file's comments, as comments.authors() labels them, from the authors in order."""
    letter = lambda i: chr(65 + i)
    return [(who, "Reviewer " + (letter(i) if i < 26 else letter(i // 26 - 1) + letter(i % 26))) for i, who in enumerate(dict.fromkeys(x for x in people if x))]


ROWS = "path string, name string, content binary, n_replaced long, error string, mapping array<struct<original:string,placeholder:string>>, authors array<struct<author:string,label:string>>"


def cloak_rows(files: DataFrame, entries: DataFrame | None = None, mode: str = comments.SANITIZE, keep_metadata: bool = False, config: DataFrame | None = None) -> DataFrame:
    """One row for each file, with all that cloak_files() makes of it but the findings: path, name, content, n_replaced, error, and arrays mapping (original, placeholder) and authors (author, label).

    A file is opened, planned and written where it is read; only entries or a configuration of its own meet it in a join."""
    by_doc = lambda df: None if df is None else df.withColumnRenamed("path", "doc_id")
    rows = docx.opened(files, content=True).select(F.col("path").alias("doc_id"), "content", "text", F.transform("said", lambda c: c["author"]).alias("people"))
    if entries is None and config is None:
        rows = detect.with_parties(rows)

    def run(path, content, text, people, *given):
        steps, labels = steps_of(text, *given), reviewers(people or ())
        name = path.rpartition("/")[2]
        made = [(path, planning.clean_name(name, steps.known) if text is not None else name)]
        try:
            words = planning.Rewriter(planning.comment_words(steps.keys, text))
            data, n = docx.edited(bytes(content), planning.Rewriter((k, v) for k, v in steps.keys if v is not None), mode, dict(labels), words, not keep_metadata)
            made += (data, n, None)
        except Exception as e:  # a broken file must not end the job: it is reported as a row
            made += (None, 0, str(e)[:200] or type(e).__name__)
        return [(*made[0], *made[1:], steps.keys, labels if mode == comments.SANITIZE else [])]

    return folded(carrying(rows, by_doc(entries), by_doc(config)), ["doc_id", "content", "text", "people", *CARRIED], ROWS, run)


def cloak_files(files: DataFrame, entries: DataFrame | None = None, mode: str = comments.SANITIZE, keep_metadata: bool = False, config: DataFrame | None = None) -> Cloaked:
    """Cloak files (path, content) by entries (path, ord, placeholder, original), by a configuration (path and the columns of
    K.configured()), or by the parties that each names.

    Texts, comments, properties and file names change as plan() tells; comments also lose the initialisms of
    names that the text holds. The mapping, the authors and the findings of the scan are as of the files
    before. A file that cannot be opened or edited is a row with an error and no content. Each of the results
    is worked out when it is asked for; who wants several of them takes cloak_rows()."""
    rows = cloak_rows(files, entries, mode, keep_metadata, config)
    return Cloaked(
        rows.select("path", "name", "content", "n_replaced", "error"), rows.select("path", F.inline("mapping")), rows.select("path", F.inline("authors")),
        security.scan_rows(docx.scanned(files)).withColumnRenamed("doc_id", "path"),
    )


def uncloak_rows(rows: DataFrame) -> DataFrame:
    """(path, content, n_replaced, error): files restored that carry the arrays mapping and authors of cloak_rows(), as uncloak_files() does.

    Of originals with one placeholder the first by code point stands for all; texts of comments stay as they are."""

    def run(path, content, mapping, authors):
        people = {a["label"]: a["author"] for a in authors or () if a["label"] is not None and a["author"] is not None}
        pairs = [(who, label) for label, who in people.items()] + [(m["original"], m["placeholder"]) for m in mapping or () if m["original"] is not None and m["placeholder"] is not None]
        back: dict = {}
        for value, key in sorted(pairs):
            back.setdefault(key, value)
        try:
            return [(path, *docx.edited(bytes(content), planning.Rewriter(back.items()), comments.SANITIZE, people, None, False), None)]
        except Exception as e:  # a broken file must not end the job: it is reported as a row
            return [(path, None, 0, str(e)[:200] or type(e).__name__)]

    return folded(rows, ["path", "content", "mapping", "authors"], "path string, content binary, n_replaced long, error string", run)


def uncloak_files(files: DataFrame, mapping: DataFrame, authors: DataFrame) -> DataFrame:
    """(path, content, n_replaced, error): placeholders and reviewer labels back to originals, and comments to their authors; see uncloak_rows()."""
    gathered = lambda df, name, *columns: df.groupBy("path").agg(F.collect_list(F.struct(*columns)).alias(name))
    both = gathered(mapping, "mapping", "original", "placeholder").join(gathered(authors, "authors", "author", "label"), "path", "full_outer")
    return uncloak_rows(files.select("path", "content").join(dealt(both), "path", "left"))
