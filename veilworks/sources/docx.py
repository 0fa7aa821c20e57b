"""Word documents as tables: a scan of binary files into paragraphs, runs, comments and properties, and a sink.

Parsing needs a worker, as the format is a ZIP of XML; all that follows is relational. A file that
cannot be read gives a row with an error code instead of an exception.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.functions.lineage import dealt, folded
from veilworks.functions.rewriter import Rewriter
from veilworks.functions.stores import store_at

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NOT_FOUND, UNSUPPORTED, ENCRYPTED, BROKEN = "not_found", "unsupported_format", "password_protected", "load_error"
TEXT_PARTS = re.compile(r"word/(document|footnotes|endnotes|header\d*|footer\d*)\.xml")
PARAGRAPHS = "path string, error string, seq long, surface string, section int, row int, cell int, location string, text string, runs array<struct<text:string,size_half_pt:int,hidden:boolean,color_rgb:string,revision:string>>"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files at a path that any of Spark's stores may hold."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def listed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content) of each listed path; content is null where no file stands, which parses to an error row."""
    return listing.select("path").join(dealt(files.select("path", "content")), "path", "left")


def save_files(files: DataFrame, folder: str, root: str | None = None) -> None:
    """Write (path, content) below a folder that all executors share, in any store that its address names.

    A file goes under its path below `root`, or without one under the last part of its path; two files
    of one name are an error before anything is written. A file appears under its name only when it is
    whole, so a task that runs again does no harm."""
    name = F.regexp_extract("path", "[^/]+$", 0) if root is None else F.expr(f"substr(path, {len(root.rstrip('/')) + 2})")
    named = files.select("path", name.alias("name"), "content")
    twice = named.groupBy("name").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several files would be written as {', '.join(sorted(r['name'] for r in twice))}")

    def write(rows) -> None:
        store, base = store_at(folder)
        for r in rows:
            target = f"{base}/{r['name']}"
            store.create_dir(os.path.dirname(target), recursive=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(r["content"])
            store.move(part, target)

    named.select("name", "content").foreachPartition(write)


def parts(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, part, data) of the archive's parts, or of those named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if names is None or n in names:
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([z.read(n)], pa.binary())], ["path", "part", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, part string, data binary")


def sniff(content: Column, path: Column) -> Column:
    """The error code that name and first bytes decide without parsing; null where parsing may begin."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(~F.lower(path).endswith(".docx"), UNSUPPORTED).when(head != "504B0304", UNSUPPORTED)


def is_ole2(content: Column) -> Column:
    """Whether the bytes begin like an encrypted or legacy container."""
    return F.hex(F.substring(content, 1, 4)) == "D0CF11E0"


def safe_xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!DOCTYPE|<!ENTITY", data):
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(data)


_T, _TAB, _BR, _R, _LOOK = W + "t", W + "tab", W + "br", W + "r", W + "rPr"
_NO_LOOK = {"size_half_pt": None, "hidden": False, "color_rgb": None}


def _said(r: ElementTree.Element) -> str:
    out = ""
    for e in r:
        if e.tag == _T:
            out += e.text or ""
        elif e.tag == _TAB or e.tag == _BR:
            out += "\t" if e.tag == _TAB else "\n"
    return out


def _look(look: ElementTree.Element) -> dict:
    size, color, vanish = look.find(W + "sz"), look.find(W + "color"), look.find(W + "vanish")
    value = None if color is None else color.get(W + "val")
    return {
        "size_half_pt": None if size is None else int(float(size.get(W + "val"))), "hidden": vanish is not None and vanish.get(W + "val") not in ("0", "false"),
        "color_rgb": value if value and re.fullmatch("[0-9A-Fa-f]{6}", value) else None,
    }


def _runs(p: ElementTree.Element) -> list[dict]:
    out = []
    for holder, revision in [(p, None), *[(e, e.tag[len(W) :]) for e in p if e.tag in (W + "ins", W + "hyperlink")]]:
        for r in holder.findall(_R):
            look = r.find(_LOOK)
            out.append({"text": _said(r), **(_NO_LOOK if look is None else _look(look)), "revision": revision})
    return out


def _blocks(root: ElementTree.Element, surface: str, section: int, label: str) -> Iterator[dict]:
    """Paragraphs first, then cells of tables, nested ones after their cell's own text."""

    def one(p, location, row=None, cell=None, kind=surface):
        runs = _runs(p)
        return {"surface": kind, "section": section, "row": row, "cell": cell, "location": location, "text": "".join(r["text"] for r in runs), "runs": runs}

    def table(t, prefix):
        for i, tr in enumerate(t.findall(W + "tr"), 1):
            for j, tc in enumerate(tr.findall(W + "tc"), 1):
                where = f"{prefix}, Row {i}, Cell {j}"
                for p in tc.findall(W + "p"):
                    yield one(p, where, i, j, "table")
                for k, inner in enumerate(tc.findall(W + "tbl"), 1):
                    yield from table(inner, f"{where}, Table {k}")

    for i, p in enumerate(root.findall(W + "p"), 1):
        yield one(p, f"Paragraph {i}" if surface == "body" else label)
    for i, t in enumerate(root.findall(W + "tbl"), 1):
        yield from table(t, f"Table {i}" if surface == "body" else f"{label}, Table {i}")


def parse(path: str, content: bytes | None) -> list[dict]:
    none = {"path": path, "error": None, "seq": None, "surface": None, "section": None, "row": None, "cell": None, "location": None, "text": None, "runs": None}
    if content is None:
        return [none | {"error": NOT_FOUND}]
    if not path.lower().endswith(".docx"):
        return [none | {"error": UNSUPPORTED}]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "EncryptedPackage" in names:
                return [none | {"error": ENCRYPTED}]
            body = safe_xml(z.read("word/document.xml")).find(W + "body")
            found = list(_blocks(body, "body", 1, ""))
            for kind in ("header", "footer"):
                for i, n in enumerate(sorted(n for n in names if re.fullmatch(rf"word/{kind}\d*\.xml", n)), 1):
                    found += _blocks(safe_xml(z.read(n)), kind, i, f"Section {i} {kind.capitalize()}")
        return [none | f | {"seq": i} for i, f in enumerate(found)]
    except Exception as e:  # a broken file must not end the job: it is reported as a row
        return [none | ({"error": BROKEN, "text": str(e)[:200]} if zipfile.is_zipfile(io.BytesIO(content)) else {"error": UNSUPPORTED})]


def paragraphs(files: DataFrame) -> DataFrame:
    """One row for each paragraph of each file, in reading order; or one row with an error."""

    look = pa.struct([("text", pa.string()), ("size_half_pt", pa.int32()), ("hidden", pa.bool_()), ("color_rgb", pa.string()), ("revision", pa.string())])
    kinds = {"seq": pa.int64(), "section": pa.int32(), "row": pa.int32(), "cell": pa.int32(), "runs": pa.list_(look)}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in PARAGRAPHS.split("runs")[0].split(", ") if c] + [("runs", kinds["runs"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                held += parse(path, content)
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, PARAGRAPHS)


def joined(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the texts of each key's parts in order, one a line."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def texts(parsed: DataFrame) -> DataFrame:
    """(path, text): non-blank paragraphs on end, one a line."""
    return joined(parsed.filter(F.col("error").isNull() & F.col("text").rlike(r"(?U)\S")), "path", "seq")


def runs(parsed: DataFrame) -> DataFrame:
    """(doc_id, seq, location, run_idx, text, size_half_pt, hidden, color_rgb) of the runs that a scan for hidden text reads."""
    rows = parsed.filter(F.col("error").isNull() & ~F.col("location").rlike("^Section .*Table")).select(F.col("path").alias("doc_id"), "seq", "location", F.posexplode("runs").alias("run_idx", "r"))
    return rows.filter("r.revision IS NULL").select("doc_id", "seq", "location", "run_idx", "r.text", "r.size_half_pt", "r.hidden", "r.color_rgb")


#: The properties that a scan reads, by the names it gives them.
SCANNED = {"Author": "creator", "Last Modified By": "lastModifiedBy", "Subject": "subject", "Keywords": "keywords", "Comments": "description", "Title": "title", "Category": "category"}


def fields(properties: DataFrame) -> DataFrame:
    """(doc_id, field_no, field, value) of the core properties that a scan reads."""
    rows = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(k).alias("field"), F.coalesce(F.col("core")[v], F.lit("")).alias("value")) for i, (k, v) in enumerate(SCANNED.items())])
    return properties.select(F.col("path").alias("doc_id"), F.inline(rows))


def texts_for_scanning(parsed: DataFrame) -> DataFrame:
    """(path, seq, location, text) as the security scan reads a file: cells as a whole, blocks stripped, no tables of headers."""
    kept = parsed.filter(F.col("error").isNull() & ~F.col("location").rlike("^Section .*Table"))
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    key = F.when(F.col("surface") == "table", F.lit(-1)).otherwise(F.col("seq"))
    whole = kept.groupBy("path", "location", key.alias("_block")).agg(F.min("seq").alias("seq"), F.regexp_replace(cell, r"(?U)^\s+|\s+$", "").alias("text"))
    return whole.filter("text <> ''").select("path", "seq", "location", "text")


def edit_parts(content: bytes, edit: Callable[[str, bytes], bytes | None]) -> bytes:
    """The archive with each part as edit() returns it; None drops the part."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as sink:
        for item in source.infolist():
            data = edit(item.filename, source.read(item))
            if data is not None:  # what deflating a short part spares is less than what it costs
                sink.writestr(item.filename, data, zipfile.ZIP_STORED if len(data) < 1024 else None)
    return out.getvalue()


def replace_in_parts(content: bytes, lookup: dict[str, str], match_case: bool = False) -> tuple[bytes, int]:
    """Text elements of all text parts rewritten in one pass each; the number of replacements."""
    if not lookup:
        return content, 0
    from xml.sax.saxutils import escape, unescape

    keys = {k.lower(): v for k, v in lookup.items()}
    pattern = re.compile("|".join(re.escape(k) for k in sorted(lookup, key=len, reverse=True)), re.IGNORECASE)
    total = 0

    def text(m: re.Match) -> str:
        nonlocal total
        new, n = pattern.subn(lambda x: in_case(x[0], keys.get(x[0].lower(), x[0]), match_case), unescape(m[2], {"&quot;": '"', "&apos;": "'"}))
        total += n
        return m[1] + escape(new) + m[3]

    def edit(name: str, data: bytes) -> bytes:
        if not TEXT_PARTS.fullmatch(name):
            return data
        return re.sub(r"(<w:t(?:\s[^>]*)?>)([^<]*)(</w:t>)", text, data.decode()).encode()

    return edit_parts(content, edit), total


def splice(runs: list[str], lookup: dict[str, str], match_case: bool = False) -> list[str]:
    """Replace over the joined runs: the first run that a match touches takes the whole replacement."""
    keys = {k.lower(): v for k, v in lookup.items()}
    pattern = re.compile("|".join(re.escape(k) for k in sorted(lookup, key=len, reverse=True)), re.IGNORECASE)
    joined, edges, at = "".join(runs), [], 0
    for r in runs:
        edges.append((at, at + len(r)))
        at += len(r)
    out = [""] * len(runs)
    place = lambda i: next(k for k, (a, b) in enumerate(edges) if a <= i < b)
    before = 0

    def copy(a: int, b: int) -> None:
        for k, (lo, hi) in enumerate(edges):
            out[k] += joined[max(a, lo) : max(max(a, lo), min(b, hi))]

    for m in pattern.finditer(joined):
        copy(before, m.start())
        out[place(m.start())] += in_case(m[0], keys.get(m[0].lower(), m[0]), match_case)
        before = m.end()
    copy(before, len(joined))
    return out


def collapse(runs: list[str], lookup: dict[str, str], match_case: bool = False) -> list[str]:
    """Replace over the joined runs and put all of it into the first run, which keeps its looks; without a match the runs stay."""
    keys = {k.lower(): v for k, v in lookup.items()}
    pattern = re.compile("|".join(re.escape(k) for k in sorted(lookup, key=len, reverse=True)), re.IGNORECASE)
    new, n = pattern.subn(lambda m: in_case(m[0], keys.get(m[0].lower(), m[0]), match_case), "".join(runs))
    return [new, *[""] * (len(runs) - 1)] if n else list(runs)


def replace_runs(runs: list[str], lookup: dict[str, str], match_case: bool = False) -> tuple[list[str], bool]:
    """The runs after replacement, and whether they had to be collapsed: looks are kept where every match can be placed."""
    try:
        return splice(runs, lookup, match_case), False
    except (KeyError, IndexError, StopIteration):
        return collapse(runs, lookup, match_case), True


def transfer_case(original: str, replacement: str) -> str:
    """The replacement in the case of what it replaces; bracketed labels stay as they are."""
    if not original or not replacement or (len(replacement) > 1 and replacement[0] == "[" and replacement[-1] == "]"):
        return replacement
    if original.isupper() or original.islower():
        return replacement.upper() if original.isupper() else replacement.lower()
    if original.istitle() or all(w[0].isupper() for w in original.split()):
        return replacement.title()
    if original[0].isupper():
        return replacement[0].upper() + replacement[1:]
    out: list[str] = []
    for i, c in enumerate(replacement):
        model = original[i] if i < len(original) else (out[-1] if out else "")
        out.append(c.upper() if model.isupper() else c.lower() if model.islower() else c)
    return "".join(out)


def in_case(original: str, replacement: str, match_case: bool) -> str:
    return transfer_case(original, replacement) if match_case else replacement


def rewrite_files(files: DataFrame, lookups: DataFrame, match_case: bool = False) -> DataFrame:
    """(path, content, n_replaced): files rewritten by lookups (path, lookup map<string,string>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [replace_in_parts(bytes(c), dict(m or {}), match_case) for c, m in zip(f["content"], f["lookup"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": [g[0] for g in got], "n_replaced": [g[1] for g in got]})

    return files.join(dealt(lookups), "path", "left").select("path", "content", "lookup").mapInPandas(run, "path string, content binary, n_replaced long")


_CORE = {"creator": "", "lastModifiedBy": "", "description": "", "revision": "1", "created": "2020-01-01T00:00:00Z", "modified": "2020-01-01T00:00:00Z"}
_APP = {"Company": "", "Manager": "", "Application": "Microsoft Office Word", "Template": "Normal.dotm"}


_PROPERTY = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
_SPACES = {
    **dict.fromkeys(["creator", "description"], "http://purl.org/dc/elements/1.1/"), **dict.fromkeys(["created", "modified"], "http://purl.org/dc/terms/"),
    **dict.fromkeys(["lastModifiedBy", "revision"], _PROPERTY), **dict.fromkeys(_APP, "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"),
}


def _set(root: ElementTree.Element, values: dict[str, str]) -> None:
    """Give each named child its value; a child that is absent is made."""
    have = {e.tag.rpartition("}")[2]: e for e in root}
    for name, value in values.items():
        e = have[name] if name in have else ElementTree.SubElement(root, f"{{{_SPACES[name]}}}{name}")
        e.text = value


def strip_metadata(content: bytes, keep_comments: bool = True) -> bytes:
    """Author, history and company blanked; custom properties dropped; comments cleared if asked."""
    return edit_parts(content, lambda name, data: metadata_part(name, data, keep_comments))


def metadata_part(name: str, data: bytes, keep_comments: bool = True) -> bytes | None:
    """One part of a file after strip_metadata(); None drops it."""
    if name == "docProps/custom.xml":
        return None
    if name in ("docProps/core.xml", "docProps/app.xml") or (name == "word/comments.xml" and not keep_comments):
        root = safe_xml(data)
        if name.endswith("core.xml"):
            _set(root, _CORE)
            for e in [e for e in root if e.tag.endswith("}lastPrinted")]:
                root.remove(e)
        elif name.endswith("app.xml"):
            _set(root, _APP)
        else:
            for e in list(root):
                root.remove(e)
        return ElementTree.tostring(root, "UTF-8", xml_declaration=True)
    return data


@contextmanager
def readable(content: bytes | None) -> Iterator[zipfile.ZipFile | None]:
    """The archive, or None; an XML part that cannot be parsed ends the block, so that a broken file gives no row and ends no job."""
    if content is None or not zipfile.is_zipfile(io.BytesIO(bytes(content))):
        yield None
        return
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z, suppress(ElementTree.ParseError, ValueError, zipfile.BadZipFile):
        yield z


def properties(files: DataFrame) -> DataFrame:
    """(path, core, app, custom, n_comments): document properties as maps; empty values are absent; unreadable files have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, *got) for path, content in zip(f["path"], f["content"], strict=True) if (got := properties_of(content)) is not None]
            yield pd.DataFrame(rows, columns=["path", "core", "app", "custom", "n_comments"])

    return files.select("path", "content").mapInPandas(run, "path string, core map<string,string>, app map<string,string>, custom map<string,string>, n_comments long")


def properties_of(content: bytes | None) -> tuple[dict, dict, dict, int] | None:
    """Core, application and custom properties of a file and the number of its comments; None if it cannot be read."""

    def read(z: zipfile.ZipFile, name: str, deep: bool = False) -> dict[str, str]:
        if name not in z.namelist():
            return {}
        root = safe_xml(z.read(name))
        if deep:
            return {e.get("name"): next((x.text for x in e if x.text), "") for e in root if e.get("name")}
        return {e.tag.rpartition("}")[2]: e.text for e in root if e.text}

    with readable(content) as z:
        if z is not None:
            n = len(safe_xml(z.read("word/comments.xml")).findall(W + "comment")) if "word/comments.xml" in z.namelist() else 0
            return read(z, "docProps/core.xml"), read(z, "docProps/app.xml"), read(z, "docProps/custom.xml", True), n
    return None


def comments_of(content: bytes | None) -> list[tuple] | None:
    """(idx, id, author, initials, date, text) of a file's comments; None if they cannot be read."""
    with readable(content) as z:
        if z is not None:
            out = []
            for i, c in enumerate(safe_xml(z.read("word/comments.xml")).findall(W + "comment") if "word/comments.xml" in z.namelist() else ()):
                text = "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p"))
                out.append((i, c.get(W + "id"), c.get(W + "author", ""), c.get(W + "initials", ""), c.get(W + "date"), text))
            return out
    return None


#: What java.util.regex takes for white space, with Unicode classes.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text_of(parsed: list[dict]) -> str | None:
    """texts() of one file: its non-blank paragraphs on end; None if there is none."""
    kept = [p["text"] for p in parsed if p["error"] is None and p["text"].strip(WHITE)]
    return "\n".join(kept) if kept else None


def read_texts(files: DataFrame) -> DataFrame:
    """texts() of the paragraphs of files, each worked out where its file is read."""
    return folded(files, ["path", "content"], "path string, text string", lambda path, data: [] if (text := text_of(parse(path, data))) is None else [(path, text)])


def opened(files: DataFrame, content: bool = False, also: list[str] | None = None) -> DataFrame:
    """(path, text, n_comments, said), the content if asked, and the columns of files named by `also`: one row for each file, opened where it is.

    text as in texts(), null without any; n_comments is null where the comments cannot be read; said: (author, text) of the comments in order."""
    also = also or []

    def run(path, data, *more):
        said = comments_of(data)
        return [(path, text_of(parse(path, data)), None if said is None else len(said), [(c[2], c[5]) for c in said or ()], *more, *([data] if content else []))]

    kinds = [f"{c} {files.schema[c].dataType.simpleString()}" for c in also] + (["content binary"] if content else [])
    return folded(files, ["path", "content", *also], ", ".join(["path string, text string, n_comments long, said array<struct<author:string,text:string>>", *kinds]), run)


def scanned(files: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, runs, fields): what a security scan reads of each file, in order, as arrays in one row.

    As in texts_for_scanning(), runs() and fields(); runs without any look of their own, which nothing is found in, are left out."""

    def run(path, data):
        cells: dict = {}
        shown = []
        for p in parse(path, data):
            if p["error"] is None and not re.match("Section .*Table", p["location"]):
                cells.setdefault((p["location"], -1 if p["surface"] == "table" else p["seq"]), []).append(p)
                shown += [(p["seq"], p["location"], i, r["text"], r["size_half_pt"], r["hidden"], r["color_rgb"]) for i, r in enumerate(p["runs"]) if r["revision"] is None and (r["hidden"] or r["size_half_pt"] is not None or r["color_rgb"])]
        whole = [(ps[0]["seq"], at, "\n".join(p["text"] for p in ps).strip(WHITE)) for (at, _), ps in cells.items()]
        core = (properties_of(data) or ({},))[0]
        return [(path, sorted(x for x in whole if x[2]), shown, [(i, k, core[v]) for i, (k, v) in enumerate(SCANNED.items()) if core.get(v)])]

    return folded(
        files, ["path", "content"],
        "doc_id string, paragraphs array<struct<seq:long,location:string,text:string>>, runs array<struct<seq:long,location:string,run_idx:int,text:string,size_half_pt:int,hidden:boolean,color_rgb:string>>, fields array<struct<field_no:int,field:string,value:string>>",
        run,
    )


def comments(files: DataFrame) -> DataFrame:
    """(path, idx, id, author, initials, date, text) of all comments, paragraphs joined by line breaks; unreadable files have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, *c) for path, content in zip(f["path"], f["content"], strict=True) for c in comments_of(content) or ()]
            yield pd.DataFrame(rows, columns=["path", "idx", "id", "author", "initials", "date", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, idx long, id string, author string, initials string, date string, text string")


def edit_comments(content: bytes, mode: str, authors: dict[str, str] | None = None, lookup: dict[str, str] | None = None) -> bytes:
    """A file with its comments kept, stripped with their anchors, or sanitised: authors renamed, initials
    made from the new names, and texts rewritten verbatim. With authors turned round it restores them."""
    if mode == "keep":
        return content
    words = Rewriter((lookup or {}).items())
    return edit_parts(content, lambda name, data: comment_part(name, data, mode, authors, words))


def comment_part(name: str, data: bytes, mode: str, authors: dict[str, str] | None, words: Rewriter | None) -> bytes:
    """One part of a file after edit_comments()."""
    if name == "word/document.xml" and mode == "strip":
        return re.sub(rb"<w:comment(?:RangeStart|RangeEnd|Reference)\b[^>]*/>", b"", data)
    if name != "word/comments.xml":
        return data
    root = safe_xml(data)
    for c in root.findall(W + "comment"):
        if mode == "strip":
            root.remove(c)
            continue
        label = (authors or {}).get(c.get(W + "author", ""))
        if label:
            c.set(W + "author", label)
            c.set(W + "initials", "".join(w[0] for w in label.split()).upper())
        for t in c.iter(W + "t") if words and words.keys else ():
            t.text = words(t.text or "")[0]
    return ElementTree.tostring(root, "UTF-8", xml_declaration=True)


_ELEMENT = re.compile(r"(<w:t(?:\s[^>]*)?>)([^<]*)(</w:t>)")


def edited(content: bytes, rewrite: Rewriter | None, mode: str, authors: dict[str, str], words: Rewriter | None, strip: bool) -> tuple[bytes, int]:
    """A file after replace_in_parts(), edit_comments() and strip_metadata(), opened and written once; the number of replacements in its text parts."""
    from xml.sax.saxutils import escape, unescape

    if not (rewrite and rewrite.keys) and mode == "keep" and not strip:
        return content, 0
    total, plain = 0, {"&quot;": '"', "&apos;": "'"}

    def texts(data: str) -> str:
        held = rewrite.within(unescape(data, plain) if "&" in data else data)
        if not held.keys:
            return data

        def one(m: re.Match) -> str:
            nonlocal total
            new, n = held(unescape(m[2], plain) if "&" in m[2] else m[2])
            total += n
            return m[1] + escape(new) + m[3] if n else m[0]

        return _ELEMENT.sub(one, data)

    def edit(name: str, data: bytes) -> bytes | None:
        if rewrite and rewrite.keys and TEXT_PARTS.fullmatch(name):
            data = texts(data.decode()).encode()
        if mode != "keep":
            data = comment_part(name, data, mode, authors, words)
        return metadata_part(name, data) if strip else data

    return edit_parts(content, edit), total


def process_comments(files: DataFrame, mode: str, authors: DataFrame | None = None, lookups: DataFrame | None = None) -> DataFrame:
    """(path, content) after edit_comments(); authors (path, authors map) and lookups (path, lookup map)."""
    none = F.create_map().cast("map<string,string>")
    rows = files.select("path", "content")
    rows = rows.join(dealt(authors), "path", "left") if authors is not None else rows.withColumn("authors", none)
    rows = rows.join(dealt(lookups), "path", "left") if lookups is not None else rows.withColumn("lookup", none)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [edit_comments(bytes(c), mode, dict(a or {}), dict(m or {})) for c, a, m in zip(f["content"], f["authors"], f["lookup"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": got})

    return rows.select("path", "content", "authors", "lookup").mapInPandas(run, "path string, content binary")


def strip_files(files: DataFrame, keep_comments: bool = True) -> DataFrame:
    """(path, content) of files without metadata."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [strip_metadata(bytes(c), keep_comments) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")
