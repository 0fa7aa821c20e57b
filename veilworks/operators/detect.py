"""Entity detection as DataFrame operations: one scan runs all extractors, one exchange on doc_id serves the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilworks.functions import patterns as P
from veilworks.functions.lineage import dealt


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(P.FLAGS + P.JAVA.get(pattern, pattern)), F.lit(group))


def extract(docs: DataFrame, specs: list[tuple[str, str, int]], text: str = "text") -> DataFrame:
    """(doc_id, entity_type, family, pos, match) for specs (type, pattern, group), in one scan of docs."""
    def tagged(kind: str, family: int):
        return lambda m, i: F.struct(F.lit(kind).alias("entity_type"), F.lit(family).alias("family"), i.alias("pos"), m.alias("match"))

    parts = [F.transform(all_matches(F.col(text), p, g), tagged(t, n)) for n, (t, p, g) in enumerate(specs)]
    return docs.select("doc_id", F.inline(F.flatten(F.array(*parts))))


#: How much of a text the search for parties reads.
PREAMBLE = 2000


def preamble(text: Column) -> Column:
    return F.substring(text, 1, PREAMBLE)


def fragments(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))


def first_fragments(text: Column, n: int = 10) -> Column:
    """The first n lines that are not blank, as a text."""
    return F.array_join(F.slice(fragments(text), 1, n), "\n")


def count_matches(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id", "entity_type", F.col("match").alias("text")).agg(F.count(F.lit(1)).alias("count"))


def structured(docs: DataFrame) -> DataFrame:
    """Counts of the seven structured types; URLs inside a found e-mail address of the document are dropped."""
    return _only(docs, range(7))


def people(docs: DataFrame) -> DataFrame:
    """Person matches of all five contexts, without lower-case starts and stop words."""
    got = extract(docs, [("PERSON", p, 1) for p in P.PERSON.values()]).withColumn("match", F.trim("match"))
    return got.filter(~starts_lower(F.col("match")) & ~has_stop_word(F.col("match")))


def dates(docs: DataFrame) -> DataFrame:
    return extract(docs, [("DATE", p, 0) for p in P.DATE.values()])


def _only(docs: DataFrame, ords) -> DataFrame:
    return detect_regex(docs, frozenset(ords)).select("doc_id", "entity_type", "text", "count")


def locations(docs: DataFrame) -> DataFrame:
    """City and state references outside full addresses."""
    return _only(docs, [9])


def streets(docs: DataFrame) -> DataFrame:
    """Street addresses that neither lie in a known address or location nor hold one."""
    return _only(docs, [10])


def bare_amounts(docs: DataFrame) -> DataFrame:
    """Amounts without a currency sign after a phrase that announces one; counted as substrings of the text."""
    return _only(docs, [11])


def in_longer_word(tail: Column) -> Column:
    """The suffix goes on as a word ("Co" of "County")."""
    return tail.rlike(r"^\p{L}")


def before_agreement(tail: Column) -> Column:
    """The next word is a type of document."""
    return F.lower(F.regexp_extract(tail, r"^(?U)\s+([A-Za-z]+)", 1)).isin(P.AGREEMENT_TERMS)


def only_suffix(name: Column) -> Column:
    return (F.trim(name) == "") | name.rlike(P.FLAGS + "^ *(?:" + P.JAVA[P.BARE_SUFFIX] + ")")


def determined(name: Column) -> Column:
    return name.rlike(P.FLAGS + P.DETERMINER)


def legal_abbreviation(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[\s,.\-]+", "").isin(P.LEGAL_ABBREVIATIONS)


def has_stop_word(name: Column) -> Column:
    return F.arrays_overlap(F.split(name, r"(?U)\s+"), F.array(*[F.lit(w) for w in P.PERSON_STOP]))


def starts_lower(name: Column) -> Column:
    return name.rlike(r"^\p{Ll}")


def acceptable_company(name: Column) -> Column:
    """Neither without a name of its own, nor an address or a mention; P.COMPANY_KEPT and P.PARTY look at what follows a name."""
    return ~only_suffix(name) & ~name.startswith("Dear ") & ~determined(name)


def companies(docs: DataFrame) -> DataFrame:
    """Corporate names by suffix; matches that fail a filter still use up their text."""
    return _only(docs, [12])


#: Type and confidence of each detector by its rank, and those whose matches count together in any case.
RANKED = [*[(t, 1.0) for t, _, _ in P.STRUCTURED], ("PERSON", 1.0), ("DATE", 1.0), ("ADDRESS", 0.9), ("ADDRESS", 0.9), ("AMOUNT", 0.9), ("COMPANY", 1.0)]
ANY_CASE = (9, 10, 12)


def _found(docs: DataFrame, ords: frozenset[int], also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, found, sizes, times) and the columns of docs named by `also`: the matches of each row of docs, how many each detector of ords has, and how often the text holds each bare amount.

    What one detector leaves to another is decided within the row, on arrays: the text is read once, each
    pattern runs once, and those that nothing asks for not at all."""
    kinds = [t.lower() for t, _, _ in P.STRUCTURED]
    text = F.col("text")

    def family(patterns, group):
        return F.flatten(F.array(*[F.transform(all_matches(text, p, group), lambda m: F.trim(m)) for p in patterns.values()]))

    arrays = {
        **{k: all_matches(text, p, g) for k, (_, p, g) in zip(kinds, P.STRUCTURED, strict=True)},
        "person": family(P.PERSON, 1), "date": family(P.DATE, 0), "city": family(P.CITY_STATE, 1), "street": F.transform(all_matches(text, P.STREET, 1), lambda m: F.trim(m)),
        "bare": F.array_distinct(all_matches(text, P.BARE_AMOUNT, 1)), "raw": all_matches(text, P.COMPANY_KEPT, 2),
    }
    needs = {"email": {0, 6}, "amount": {4, 11}, "address": {5, 9, 10}, "url": {6}, "person": {7}, "date": {8}, "city": {9, 10}, "street": {10}, "bare": {11}, "raw": {12}}
    wanted = lambda k: bool(ords & needs.get(k, {kinds.index(k)} if k in kinds else set()))
    none = F.array().cast("array<string>")
    # a generator between the steps keeps each array computed once
    got = docs.select("doc_id", *also, "text", F.inline(F.array(F.struct(*[(c if wanted(k) else none).alias(k) for k, c in arrays.items()]))))
    absent = lambda known, hit: ~F.exists(known, hit)
    city = F.filter("city", lambda c: absent(F.col("address"), lambda a: a.contains(c)))
    names = F.transform(F.filter("raw", lambda m: m != ""), lambda m: F.regexp_replace(F.regexp_replace(F.trim(m), ",+$", ""), r"\.+$", ""))
    settled = {
        "url": F.filter("url", lambda u: absent(F.col("email"), lambda e: e.contains(u))),
        "city": city,
        "person": F.filter("person", lambda n: ~starts_lower(n) & ~has_stop_word(n)),
        "bare": F.filter("bare", lambda x: ~F.array_contains("amount", x)),
        "company": F.filter(names, lambda n: acceptable_company(n) & ~legal_abbreviation(n)),
    }
    keep = [k for k in [*kinds, "date", "street"] if k != "url"]
    got = got.select("doc_id", *also, "text", F.inline(F.array(F.struct(*keep, *[c.alias(k) for k, c in settled.items()]))))
    first_seen = F.filter("city", lambda c, i: F.when(i == 0, True).otherwise(~F.exists(F.slice("city", F.lit(1), i), lambda b: F.lower(b) == F.lower(c))))
    known = F.concat("address", first_seen)
    street = F.filter("street", lambda x: absent(known, lambda a: a.contains(x) | x.contains(a)))
    got = got.select("doc_id", *also, "text", *kinds, "person", "date", "city", F.inline(F.array(F.struct(street.alias("street")))), "bare", "company")
    parts = [F.col(k) if i in ords else none for i, k in enumerate([*kinds, "person", "date", "city", "street", "bare", "company"])]
    substring_count = lambda m: ((F.length("text") - F.length(F.replace("text", m))) / F.length(m)).cast("long")
    times = F.transform(parts[11], substring_count)
    return got.select("doc_id", *also, F.flatten(F.array(*parts)).alias("found"), F.array(*[F.size(p) for p in parts]).alias("sizes"), times.alias("times")).filter(F.size("found") > 0)


_bare = lambda c: F.regexp_replace(F.lower(c), "[.,]+$", "")
FOUND, MERGED, WINNERS, NUMBERED = range(4)
_COLUMNS = [
    "entity_type string, text string, confidence double, count long, ord int", *["entity_type string, text string, count long, confidence double, ord int"] * 2,
    "entity_type string, text string, count long, confidence double, placeholder string",
]


def _rows_of(groups: dict, step: int, parties: set) -> list[tuple]:
    """The rows of a document after `step`. groups: (rank, key) to [text, count, place, lower, bare]."""
    if step == FOUND:
        return [(RANKED[o][0], g[0], RANKED[o][1], g[1], o) for (o, _), g in groups.items()]
    merged: dict = {}
    for (o, _), g in groups.items():
        kind, confidence = RANKED[o]
        m = merged.get((kind, g[0]))
        if m is None:
            merged[kind, g[0]] = [g[1], confidence, o, g[3], g[4]]
        else:
            m[0], m[1], m[2] = m[0] + g[1], max(m[1], confidence), min(m[2], o)
    if step > MERGED:
        best: dict = {}
        for (kind, text), m in merged.items():
            rank = (-m[1], m[2], text, kind)
            if m[3] not in best or rank < best[m[3]]:
                best[m[3]] = rank
        merged = {k: m for k, m in merged.items() if best[m[3]][3] == k[0]}
    if step < NUMBERED:
        return [(kind, text, m[0], m[1], m[2]) for (kind, text), m in merged.items()]
    out, seen = [], {}
    for kind, n, text, confidence in sorted((kind, -m[0], text, m[1]) for (kind, text), m in merged.items() if m[4] not in parties):
        seen[kind] = i = seen.get(kind, 0) + 1
        out.append((kind, text, -n, confidence, f"[{kind.capitalize()}-{i}]"))
    return out


def _settled(docs: DataFrame, step: int, ords: frozenset[int] = frozenset(range(13)), parties: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """What the detectors find, after `step`, folded document by document: one exchange on doc_id brings the rows of
    each document together, with those of its parties, and no step needs another one or a sort of matches.

    whole: each row of docs is a whole document, with the names of its parties in an array `names`; then there is no exchange at all."""
    rows = _found(docs, ords, ("names",) if whole else ())
    if parties is not None:
        names = parties.filter("name <> '' AND doc_id IS NOT NULL").select("doc_id", F.array(_bare("name")).alias("names"))
        rows = rows.unionByName(names, allowMissingColumns=True)
    if not whole:
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    rows = rows.withColumn("lower", F.transform("found", F.lower))
    if parties is not None or whole:
        rows = rows.withColumn("bare", F.transform("lower", _bare))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_COLUMNS[step]}"
    names_of = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        out: list[list] = [[] for _ in names_of]
        groups: dict = {}
        known: set = set()
        last = None

        def close() -> None:
            got = _rows_of(groups, step, known)
            out[0].extend([last] * len(got))
            for column, values in zip(out[1:], zip(*got), strict=bool(got)):
                column.extend(values)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names_of)
            for c in out:
                c.clear()
            return made

        for b in batches:
            if kinds is None:
                number = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
                kinds = [b.schema.field("doc_id").type, *[number[c.split()[1]] for c in _COLUMNS[step].split(", ")]]
            for r in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                columns = {c: r.column(c).to_pylist() for c in r.schema.names}
                none = [None] * r.num_rows
                for i, found, sizes, times, lower, bare, names in zip(*[columns.get(c, none) for c in ("doc_id", "found", "sizes", "times", "lower", "bare", "names")], strict=True):
                    if i != last:
                        if groups:
                            close()
                        groups, known, last = {}, set(), i
                        if len(out[0]) >= 20_000:
                            yield batch()
                    if names:
                        known.update(names)
                    at = 0
                    for o, size in enumerate(sizes or ()):
                        for place in range(size):
                            text, low = found[at], lower[at]
                            n = times[place] if o == 11 else 1
                            g = groups.get(key := (o, low if o in ANY_CASE else text))
                            if g is None:
                                groups[key] = [text, n, place, low, bare[at] if bare else None]
                            else:
                                g[1] += n
                                if (place, text) < (g[2], g[0]):
                                    g[0], g[2], g[4] = text, place, bare[at] if bare else None
                            at += 1
        if groups:
            close()
        if kinds and out[0]:
            yield batch()

    return rows.mapInArrow(run, schema)


def detect_regex(docs: DataFrame, ords: frozenset[int] = frozenset(range(13))) -> DataFrame:
    """(doc_id, entity_type, text, confidence, count, ord) of every detector, without NER, or of those named by ords; ord ranks detectors and breaks ties between types."""
    return _settled(docs, FOUND, ords)


def deduplicated(docs: DataFrame) -> DataFrame:
    """merge() of what all detectors find in docs."""
    return _settled(docs, MERGED)


def typed(docs: DataFrame) -> DataFrame:
    """one_type() of deduplicated()."""
    return _settled(docs, WINNERS)


def merge(entities: DataFrame) -> DataFrame:
    """One row for each (doc_id, type, text): counts add up, the highest confidence and the earliest rank stay."""
    return entities.groupBy("doc_id", "entity_type", "text").agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))


def one_type(entities: DataFrame) -> DataFrame:
    """Rows whose type wins for their text up to case: highest confidence, then earliest detector."""
    w = Window.partitionBy("doc_id", F.lower("text")).orderBy(F.desc("confidence"), "ord", "text")
    return entities.withColumn("_win", F.first("entity_type").over(w)).filter("_win = entity_type").drop("_win")


def without_parties(entities: DataFrame, parties: DataFrame) -> DataFrame:
    """Entities that are not the name of a party (doc_id, name), trailing dots and commas aside."""
    p = parties.filter("name <> ''").select("doc_id", _bare("name").alias("_bare"))
    return entities.withColumn("_bare", _bare("text")).join(dealt(p), ["doc_id", "_bare"], "left_anti").drop("_bare")


def number(entities: DataFrame) -> DataFrame:
    """Placeholders [Type-n], numbered within document and type by falling count, then text."""
    w = Window.partitionBy("doc_id", "entity_type").orderBy(F.desc("count"), "text")
    return entities.withColumn("placeholder", F.concat(F.lit("["), F.initcap("entity_type"), F.lit("-"), F.row_number().over(w).cast("string"), F.lit("]")))


def detect(docs: DataFrame, parties: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """The whole detection: (doc_id, entity_type, text, count, confidence, placeholder). more: rows like those of detect_regex(), as a model gives them."""
    if more is None:
        return _settled(docs, NUMBERED, parties=parties)
    found = one_type(merge(detect_regex(docs).unionByName(more.withColumn("ord", F.col("ord").cast("int")))))
    if parties is not None:
        found = without_parties(found, parties)
    return number(found).select("doc_id", "entity_type", "text", "count", "confidence", "placeholder")


def preview(docs: DataFrame) -> DataFrame:
    """detect() of docs of which each row is a whole document, without the parties that it names; nothing leaves its row before it is numbered."""
    named = with_parties(docs.select("doc_id", "text"))
    rows = named.select("doc_id", "text", F.transform(F.filter("_parties", lambda p: p["name"] != ""), lambda p: _bare(p["name"])).alias("names"))
    return _settled(rows, NUMBERED, whole=True)


def initials_of(name: Column) -> Column:
    """The first letters of the capitalised words."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def is_abbreviation(label: Column, name: Column) -> Column:
    t = F.trim(label)
    upper = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) <= 10)
    return (t != "") & (upper | (F.upper(initials_of(name)) == F.upper(t)))


def strip_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, P.FLAGS + P.JAVA[P.STRIP_SUFFIX], ""))


def resembles_name(label: Column, name: Column) -> Column:
    """The label is the name, its core, or the first words of the core."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"(?U)\s+", " "))
    core = norm(strip_suffix(name))
    a = norm(label)
    leading = (a != "") & core.startswith(F.concat(a, F.lit(" ")))
    return (a == core) | (a == norm(name)) | leading


def _with_named(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs and `_named`: array of (phase, pos, name, label), the parties that the first 2000 characters name, in the order in which the first counts."""
    text = preamble(F.col("text"))
    arrays = {"near": all_matches(text, P.PARTY, 2), "adjacent": all_matches(text, P.DEFINED_TERM, 0), "dear": all_matches(text, P.DEAR, 1)}
    # a generator between the steps keeps each array computed once
    got = docs.select(*columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in arrays.items()]))))

    def party(phase: int, pos: Column, name: Column, label: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), pos.alias("pos"), name.alias("name"), label.alias("label"))

    part = lambda m, pattern, group: F.trim(F.regexp_extract(m, P.FLAGS + P.JAVA.get(pattern, pattern), group))
    no_comma = lambda c: F.regexp_replace(c, ",+$", "")
    near = F.filter(F.transform("near", lambda m, i: party(0, i, m, m)), lambda m: m["name"] != "")
    phased = F.filter(F.transform(near, lambda m: party(0, m["pos"], no_comma(part(m["name"], P.PARTY_PARTS, 1)), no_comma(part(m["name"], P.PARTY_PARTS, 2)))), lambda m: acceptable_company(m["name"]))
    adjacent = F.filter(
        F.transform("adjacent", lambda m, i: party(1, i, part(m, P.DEFINED_TERM, 1), part(m, P.DEFINED_TERM, 2))), lambda m: ~only_suffix(m["name"]) & ~m["name"].startswith("Dear ")
    )
    dear = F.transform("dear", lambda m, i: party(2, i, F.trim(m), F.lit("Addressee")))
    return got.select(*columns, F.concat(phased, adjacent, dear).alias("_named"))


def _short_label(phase: Column, name: Column, label: Column) -> Column:
    """The label stands for the name itself, not for its role."""
    return (phase < 2) & (resembles_name(label, name) | is_abbreviation(label, name))


def parties(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, name, label, defined_term): the parties that the first 2000 characters name."""
    found = _with_named(docs, ["doc_id"]).select("doc_id", F.inline("_named")).repartition("doc_id")
    first = Window.partitionBy("doc_id", F.lower("name")).orderBy("phase", "pos")
    seen = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    ranked = seen.withColumn("_role", F.row_number().over(Window.partitionBy("doc_id").orderBy("phase", "pos")))
    short = _short_label(F.col("phase"), F.col("name"), F.col("label"))
    role = F.when(F.col("_role") == 1, P.DEFAULT_ROLES[0]).otherwise(P.DEFAULT_ROLES[1])
    return ranked.select("doc_id", F.col("_role").cast("long").alias("ord"), "name", F.when(short, role).otherwise(F.col("label")).alias("label"), F.when(short, F.col("label")).alias("defined_term"))


def with_parties(docs: DataFrame) -> DataFrame:
    """docs, of which each row is a whole document, with `_parties`: array of (name, label) as parties() has them, in order and within the row."""
    columns = docs.columns
    got = _with_named(docs, columns).select(*columns, F.inline(F.array(F.struct(F.coalesce("_named", F.array().cast("array<struct<phase:int,pos:int,name:string,label:string>>")).alias("_named")))))
    first = F.filter("_named", lambda m, i: F.when(i == 0, True).otherwise(~F.exists(F.slice("_named", F.lit(1), i), lambda b: F.lower(b["name"]) == F.lower(m["name"]))))
    role = lambda i: F.when(i == 0, P.DEFAULT_ROLES[0]).otherwise(P.DEFAULT_ROLES[1])
    label = lambda m, i: F.when(_short_label(m["phase"], m["name"], m["label"]), role(i)).otherwise(m["label"])
    return got.select(*columns, F.transform(first, lambda m, i: F.struct(m["name"].alias("name"), label(m, i).alias("label"))).alias("_parties"))
