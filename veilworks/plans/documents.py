"""Queries on comments, metadata, spans, sessions and files, with their SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from veilworks.functions import patterns as P
from veilworks.operators import chunks, comments, ner, sessions, spans
from veilworks.operators import detect as D
from veilworks.operators import dictionary as K
from veilworks.plans.cloaking import DICT_CTE, entries
from veilworks.plans.contracts import CONTRACTS_CTE, contracts
from veilworks.plans.sql import in_list, lit
from veilworks.sources import docx, mappings
from veilworks.streaming import ingest

QUERIES, SQL = {}, {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


#: A character that is not white space, for RE2.
BLANK = r"[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def view(sql: str, *tables: str):
    return lambda s, d: s.sql(sql, **{t: s.read.parquet(f"{d}/{t}.parquet") for t in tables})


# comments: the turns of conversations, their roles as authors
_COMMENTS = "SELECT conv_id AS doc_id, turn AS idx, CASE WHEN turn % 3 = 2 THEN role || ' two' ELSE role END AS author, text FROM {conversations}"
_comments = view(_COMMENTS, "conversations")
_INITIALS = "upper(array_to_string(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), lambda w: left(w, 1)), ''))"
COMMENTS_CTE = f"""comments AS ({_COMMENTS.format(conversations='conversations')}),
per AS (SELECT doc_id, author, count(*) AS n, min(idx) AS first_idx FROM comments WHERE author <> '' GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) - 1 AS i FROM per),
authors AS (SELECT doc_id, author, n, {_INITIALS.format(x='author')} AS initials, 'Reviewer ' || CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) ELSE chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END AS label FROM placed)"""
add("d8_comment_authors", lambda s, d: comments.authors(_comments(s, d)).select("doc_id", "author", "n", "initials"), f"WITH {COMMENTS_CTE} SELECT doc_id, author, n, initials FROM authors")
add("e4_reviewer_labels", lambda s, d: comments.authors(_comments(s, d)).select("doc_id", "author", "label"), f"WITH {COMMENTS_CTE} SELECT doc_id, author, label FROM authors")
add("d9_comment_count", lambda s, d: comments.counts(_comments(s, d)), f"WITH {COMMENTS_CTE} SELECT doc_id, count(*) AS n FROM comments GROUP BY 1")
add("j8_sanitize_comments", lambda s, d: comments.process(_comments(s, d), comments.SANITIZE), f"WITH {COMMENTS_CTE} SELECT doc_id, idx, label AS author, {_INITIALS.format(x='label')} AS initials, text FROM comments JOIN authors USING (doc_id, author)")
add("j8_strip_comments", lambda s, d: comments.process(_comments(s, d), comments.STRIP), f"WITH {COMMENTS_CTE} SELECT * FROM comments LIMIT 0")
add(
    "j11_restore_authors",
    lambda s, d: (lambda c: comments.restore(comments.process(c, comments.SANITIZE), comments.authors(c)))(_comments(s, d)),
    f"WITH {COMMENTS_CTE} SELECT doc_id, idx, author, {_INITIALS.format(x='author')} AS initials, text FROM comments",
)
_KNOWN = "SELECT DISTINCT conv_id AS doc_id, 'assistant' AS author, 'Model' AS label FROM {conversations} WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT conv_id, 'nobody', 'Absent' FROM {conversations} WHERE conv_id % 3 = 0"
add(
    "e4_explicit_labels",
    lambda s, d: comments.authors(_comments(s, d), view(_KNOWN, "conversations")(s, d)).select("doc_id", "author", "label"),
    f"""WITH {COMMENTS_CTE}, known AS ({_KNOWN.format(conversations='conversations')}), sizes AS (SELECT doc_id, count(*) AS n FROM known GROUP BY doc_id),
new AS (SELECT doc_id, author, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) - 1 AS i FROM per p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = p.doc_id AND k.author = p.author))
SELECT doc_id, author, k.label FROM per JOIN known k USING (doc_id, author) UNION ALL SELECT doc_id, author, 'Reviewer ' || chr(CAST(65 + i + coalesce(n, 0) AS INTEGER)) FROM new LEFT JOIN sizes USING (doc_id)""",
)
add(
    "f8_comment_previews",
    lambda s, d: comments.first_shown(_comments(s, d)),
    f"WITH {COMMENTS_CTE} SELECT doc_id, idx, author, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS text FROM comments QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 5",
)
add("j13_escape_xml", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", comments.escape_xml(F.col("html")).alias("x")), "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS x FROM pages")
_XML = "SELECT o_orderkey AS doc_id, '<w:p><w:commentRangeStart w:id=\"' || CAST(o_orderkey AS STRING) || '\"/><w:t>' || o_orderpriority || '</w:t><w:commentRangeEnd w:id=\"1\"/><w:r><w:commentReference w:id=\"1\"/></w:r></w:p>' AS xml FROM {orders}"
add("j9_strip_anchors", lambda s, d: view(_XML, "orders")(s, d).select("doc_id", comments.strip_anchors(F.col("xml")).alias("xml")), f"WITH x AS ({_XML.format(orders='orders')}) SELECT doc_id, regexp_replace(xml, '<w:comment(RangeStart|RangeEnd|Reference)[^>]*/>', '', 'g') AS xml FROM x")
_META = """SELECT c_custkey AS doc_id, c_name AS creator, c_mktsegment AS last_modified_by, 'about' AS description, CAST(c_custkey % 9 AS STRING) AS revision, '2024-05-01T10:00:00Z' AS created,
 '2024-05-02T10:00:00Z' AS modified, '2024-05-03T10:00:00Z' AS last_printed, c_name AS title, c_mktsegment AS keywords FROM {customer}"""
add("j4_core_clean", lambda s, d: comments.clean_core(view(_META, "customer")(s, d)), f"WITH m AS ({_META.format(customer='customer')}) SELECT doc_id, '' AS creator, '' AS last_modified_by, '' AS description, '1' AS revision, '2020-01-01T00:00:00Z' AS created, '2020-01-01T00:00:00Z' AS modified, CAST(NULL AS VARCHAR) AS last_printed, title, keywords FROM m")
_APP = "SELECT s_suppkey AS doc_id, s_name AS company, s_name AS manager, 'Other Writer' AS application, 'My.dotm' AS template, '16.0000' AS app_version FROM {supplier}"
add("j5_app_clean", lambda s, d: comments.clean_app(view(_APP, "supplier")(s, d)), "SELECT s_suppkey AS doc_id, '' AS company, '' AS manager, 'Microsoft Office Word' AS application, 'Normal.dotm' AS template, '16.0000' AS app_version FROM supplier")

# spans: logits from line items
_LOGITS = """SELECT l_orderkey AS doc_id, CAST(8 AS INT) AS n, CAST(l_partkey % 8 AS INT) AS start, CAST(l_suppkey % 4 AS INT) AS k, CASE l_linenumber % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'address' END AS label,
 max(CAST(l_quantity AS INT) - 25) AS logit FROM {lineitem} GROUP BY l_orderkey, l_partkey % 8, l_suppkey % 4, l_linenumber % 3"""
_logits = view(_LOGITS, "lineitem")
LOGITS = f"logits AS ({_LOGITS.format(lineitem='lineitem')}), cand AS (SELECT doc_id, start, start + k AS \"end\", label, CAST(1.0 / (1.0 + exp(-CAST(logit AS DOUBLE))) AS FLOAT) AS score FROM logits WHERE start + k < n), dec AS (SELECT * FROM cand WHERE CAST(score AS DOUBLE) > 0.45)"
add("m7_sigmoid", lambda s, d: _logits(s, d).select("doc_id", "start", "k", "label", F.round(spans.sigmoid(F.col("logit")).cast("double"), 6).alias("p")), f"WITH {LOGITS} SELECT doc_id, start, k, label, round(CAST(CAST(1.0 / (1.0 + exp(-CAST(logit AS DOUBLE))) AS FLOAT) AS DOUBLE), 6) AS p FROM logits")
_dec = lambda s, d: spans.decode(_logits(s, d), 0.45)
_round = lambda df: df.withColumn("score", F.round(F.col("score").cast("double"), 6))
add("m8_decode", lambda s, d: _round(_dec(s, d)), f"WITH {LOGITS} SELECT doc_id, start, \"end\", label, round(CAST(score AS DOUBLE), 6) AS score FROM dec")
add(
    "b10_label_threshold",
    lambda s, d: _round(spans.by_label_threshold(_dec(s, d))),
    f"WITH {LOGITS} SELECT doc_id, start, \"end\", label, round(CAST(score AS DOUBLE), 6) AS score, CASE label WHEN 'person' THEN 'PERSON' WHEN 'organization' THEN 'COMPANY' ELSE 'ADDRESS' END AS entity_type FROM dec WHERE CAST(score AS DOUBLE) >= CASE label WHEN 'person' THEN 0.45 ELSE 0.5 END",
)
add(
    "c10_overlap",
    lambda s, d: spans.overlapping(_dec(s, d)),
    f"WITH {LOGITS} SELECT a.doc_id, a.start AS a_start, a.\"end\" AS a_end, b.start AS b_start, b.\"end\" AS b_end FROM dec a JOIN dec b ON a.doc_id = b.doc_id AND a.start < b.start AND a.start <= b.\"end\" AND b.start <= a.\"end\"",
)
add(
    "m9_greedy",
    lambda s, d: _round(spans.greedy(_dec(s, d))),
    f"""WITH RECURSIVE {LOGITS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, "end", label) AS r FROM dec),
walk AS (SELECT doc_id, r, [r] AS kept, [{{'a': start, 'b': "end"}}] AS spans FROM o WHERE r = 1
 UNION ALL SELECT o.doc_id, o.r, CASE WHEN len(list_filter(w.spans, lambda x: x.a <= o."end" AND o.start <= x.b)) > 0 THEN w.kept ELSE list_append(w.kept, o.r) END,
  CASE WHEN len(list_filter(w.spans, lambda x: x.a <= o."end" AND o.start <= x.b)) > 0 THEN w.spans ELSE list_append(w.spans, {{'a': o.start, 'b': o."end"}}) END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.r = w.r + 1),
fin AS (SELECT doc_id, arg_max(kept, r) AS kept FROM walk GROUP BY doc_id)
SELECT o.doc_id, start, "end", label, round(CAST(score AS DOUBLE), 6) AS score FROM o JOIN fin USING (doc_id) WHERE list_contains(kept, r)""",
)
_SIZES = "SELECT o_orderkey AS doc_id, CAST(o_custkey % 6 AS INT) AS n FROM {orders}"
add("m6_spans", lambda s, d: spans.span_table(view(_SIZES, "orders")(s, d), 3), f"WITH z AS ({_SIZES.format(orders='orders')}), st AS (SELECT doc_id, n, unnest(range(0, n)) AS start FROM z) SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + w AS INTEGER) AS \"end\", start + w < n AS valid FROM st, (SELECT unnest(range(0, 3)) AS w)")
add("m3_words", lambda s, d: contracts(s, d).select("doc_id", F.size(spans.words(F.col("text"))).cast("long").alias("n"), F.array_join(spans.words(F.col("text")), "|").alias("words")), f"WITH {CONTRACTS_CTE}, w AS (SELECT doc_id, regexp_extract_all(text, '\\w+(?:[-_]\\w+)*|\\S') AS ws FROM contracts) SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, '|') AS words FROM w")
add("m12_label_map", lambda s, d: s.createDataFrame(sorted(P.NER_LABELS.items()), "label string, entity_type string"), "SELECT * FROM (VALUES ('address','ADDRESS'), ('organization','COMPANY'), ('person','PERSON')) v(label, entity_type)")
_IDS = "SELECT o_orderkey AS doc_id, array(CAST(NULL AS INT), 0, 0, 1, CAST(NULL AS INT), 2, 2, CAST(2 + o_custkey % 2 AS INT), 4) AS ids, CAST(o_orderkey % 3 AS INT) AS prompt FROM {orders}"
add(
    "m5_words_mask",
    lambda s, d: view(_IDS, "orders")(s, d).select("doc_id", spans.words_mask(F.col("ids"), F.col("prompt")).alias("mask")),
    f"""WITH x AS ({_IDS.format(orders='orders').replace('array(', 'list_value(')}), f AS (SELECT doc_id, prompt, list_transform(ids, lambda w, i: w IS NOT NULL AND (i = 1 OR w IS DISTINCT FROM ids[i - 1])) AS new FROM x),
c AS (SELECT doc_id, prompt, new, list_transform(new, lambda w, i: len(list_filter(new[1:i], lambda y: y))) AS seen FROM f)
SELECT doc_id, list_transform(new, lambda w, i: CAST(CASE WHEN w AND seen[i] > prompt THEN seen[i] - prompt ELSE 0 END AS INTEGER)) AS mask FROM c""",
)
_KINDS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 12 WHEN 0 THEN 'the parties' WHEN 1 THEN 'Jane Doe' WHEN 2 THEN 'devices such' WHEN 3 THEN 'any other Acme LLC' WHEN 4 THEN 'Company and its affiliates' WHEN 5 THEN 'Defend Trade Secrets Act'
 WHEN 6 THEN 'American Arbitration Association' WHEN 7 THEN 'ABC' WHEN 8 THEN 'premises' WHEN 9 THEN '12 Oak Street' WHEN 10 THEN 'Securities Board (SEC)' ELSE 'LLC' END AS text,
 CASE o_custkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'COMPANY' ELSE 'ADDRESS' END AS kind FROM {orders}"""
add(
    "b9_entity_filter",
    lambda s, d: view(_KINDS, "orders")(s, d).select("doc_id", spans.accept(F.col("text"), F.col("kind")).alias("text")).filter("text IS NOT NULL"),
    f"""WITH r AS ({_KINDS.format(orders='orders')}), c AS (SELECT *, trim(regexp_replace(text, {lit(P.NER_DETERMINER)}, '')) AS c FROM r),
x AS (SELECT *, regexp_extract_all(c, '[A-Za-z]+') AS ws, rtrim(c, '.,;:') AS bare FROM c)
SELECT doc_id, CASE WHEN kind = 'COMPANY' THEN c ELSE text END AS text FROM x WHERE CASE kind
 WHEN 'PERSON' THEN NOT lower(text) IN {in_list(P.NER_PERSON_BLOCK)} AND NOT regexp_matches(text, '^[a-z]')
 WHEN 'COMPANY' THEN c <> '' AND NOT lower(string_split(c, ' ')[1]) IN {in_list(P.LEGAL_ROLES)} AND len(list_filter(ws, lambda w: lower(w) IN {in_list(P.INSTITUTIONS)})) = 0
   AND NOT lower(rtrim(string_split(c, ' ')[-1], '.,;:')) IN {in_list(P.STATUTE_WORDS)} AND len(list_filter(ws, lambda w: w IN {in_list(P.LEGAL_ABBREVIATIONS)})) = 0
   AND NOT (bare = upper(bare) AND bare <> lower(bare) AND length(bare) BETWEEN 2 AND 5 AND NOT lower(bare) IN {in_list(P.SUFFIX_WORDS)})
 ELSE NOT lower(text) IN {in_list(P.ADDRESS_BLOCK)} AND regexp_matches(text, '[0-9]') END""",
)
#: a: the open chunk's first sentence, i: the sentence to come; a full chunk leaves the longest run of last sentences within the overlap.
_CHUNKS = r"""WITH RECURSIVE sentences AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE regexp_matches(text, '\S')),
tokens AS (SELECT doc_id, ss, list_transform(ss, lambda s: list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) AS ws FROM sentences),
sized AS (SELECT doc_id, ss, ws, list_transform(ws, lambda w: len(w)) AS ns FROM tokens),
walk AS (
  SELECT doc_id, 1::BIGINT AS i, 1::BIGINT AS a, 0::BIGINT AS pos, CAST([] AS STRUCT(c VARCHAR, o BIGINT)[]) AS done FROM sized
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN long_ THEN i + 1 WHEN full_ THEN rest ELSE a END,
    CASE WHEN long_ THEN begin_ + length(array_to_string(ws[i], ' ')) + 1 WHEN full_ THEN pos + length(body) + CASE WHEN rest < i THEN -length(array_to_string(ss[rest:i - 1], ' ')) ELSE 1 END ELSE pos END,
    list_concat(done, CASE WHEN (long_ AND a < i) OR (full_ AND NOT long_) THEN [{'c': body, 'o': pos}] ELSE [] END,
      CASE WHEN long_ THEN list_transform(range(0, ns[i], 300), lambda j: {'c': array_to_string(ws[i][j + 1:j + 350], ' '), 'o': begin_ + CASE WHEN j > 0 THEN length(array_to_string(ws[i][1:j], ' ')) + 1 ELSE 0 END}) ELSE [] END)
  FROM (SELECT *, pos + CASE WHEN a < i THEN length(body) + 1 ELSE 0 END AS begin_ FROM (
    SELECT w.*, ss, ws, ns, ns[i] > 350 AS long_, a < i AND list_sum(ns[a:i - 1]) + ns[i] > 350 AS full_, array_to_string(ss[a:i - 1], ' ') AS body,
      coalesce(list_min(list_filter(range(a, i), lambda k: list_sum(ns[k:i - 1]) <= 50)), i) AS rest FROM walk w JOIN sized USING (doc_id) WHERE i <= len(ns)))),
ended AS (SELECT doc_id, CASE WHEN a < i THEN list_append(done, {'c': array_to_string(ss[a:i - 1], ' '), 'o': pos}) ELSE done END AS cs FROM walk JOIN sized USING (doc_id) WHERE i = len(ns) + 1)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_no, CAST(cs[n].o AS INTEGER) AS "offset", cs[n].c AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS n FROM ended)"""
add("e8_chunks", lambda s, d: chunks.chunk(s.read.parquet(f"{d}/documents.parquet")), _CHUNKS)

# sessions and uploads: events
_SESSIONS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad stamp' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN '2026-01-15T10:00:00+0000' ELSE '2026-01-13T10:00:00+0000' END AS created FROM {events}"""
add(
    "n3_ttl",
    lambda s, d: sessions.expired(view(_SESSIONS, "events")(s, d), F.expr("TIMESTAMP '2026-01-15 12:00:00'")),
    f"WITH x AS ({_SESSIONS.format(events='events')}) SELECT event_id, created, NOT coalesce(created LIKE '____-%' AND CAST(left(created, 19) AS TIMESTAMP) > TIMESTAMP '2026-01-14 12:00:00', false) AS expired FROM x".replace("CAST(left(created, 19) AS TIMESTAMP)", "try_cast(left(created, 19) AS TIMESTAMP)"),
)
_IDS2 = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN lpad(CAST(event_id AS STRING), 8, 'a') WHEN 1 THEN 'XYZ' ELSE '../etc' END AS session_id, CASE event_id % 2 WHEN 0 THEN 'Draft.DOCX' ELSE 'draft v2.pdf' END AS name, event_id * 100000 AS length FROM {events}"
add(
    "b14_session_names",
    lambda s, d: view(_IDS2, "events")(s, d).select("event_id", sessions.valid_session(F.col("session_id")).alias("ok_session"), sessions.valid_filename(F.col("name")).alias("ok_name")),
    f"WITH x AS ({_IDS2.format(events='events')}) SELECT event_id, regexp_matches(session_id, '^[a-f0-9]{{8}}$') AS ok_session, regexp_matches(name, '^[a-zA-Z0-9._-]+$') AS ok_name FROM x",
)
add(
    "a10_uploads",
    lambda s, d: view(_IDS2, "events")(s, d).filter(sessions.accepted_upload(F.col("name"), F.col("length"))).select("event_id", "name", "length"),
    f"WITH x AS ({_IDS2.format(events='events')}) SELECT event_id, name, length FROM x WHERE lower(name) LIKE '%.docx' AND length <= 104857600",
)
QUERIES["n1_create_sessions"] = lambda s, d: sessions.create(s, 100)
_LOADED = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'load_error' END AS error FROM {orders}"
_EVENTS = ", ".join("{" + f"'step': {i}, 'stage': {lit(k)}, 'message': {lit(m)}" + "}" for i, (k, m) in enumerate([*ingest.STEPS, ("complete", "Done")], 1))
add(
    "n5_progress",
    lambda s, d: ingest.progress(view(_LOADED, "orders")(s, d)),
    f"""WITH l AS ({_LOADED.format(orders='orders')}), e AS (SELECT doc_id, unnest([{_EVENTS}]) AS e FROM l WHERE error IS NULL)
SELECT doc_id, CAST(e.step AS INTEGER) AS step, '{{"stage":"' || e.stage || '","step":' || CAST(e.step AS VARCHAR) || ',"total":5,"message":"' || e.message || '"}}' AS line FROM e
UNION ALL SELECT doc_id, NULL, '{{"stage":"error","message":"Failed to load document: ' || error || '"}}' FROM l WHERE error IS NOT NULL""",
)

# first lines and limits
add("f5_preamble", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", D.preamble(F.col("text")).alias("preamble")), "SELECT doc_id, left(text, 2000) AS preamble FROM documents")
add("f7_ner_limit", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", ner.limited(F.col("text")).alias("ner_text")), "SELECT doc_id, left(text, 200000) AS ner_text FROM documents")
add(
    "f6_first_fragments",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", D.first_fragments(F.col("text")).alias("head")),
    f"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit(BLANK)}))[1:10], chr(10)) AS head FROM documents",
)
add(
    "d11_assemble",
    lambda s, d: docx.joined(s.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn"),
    "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
)

# mapping files
add("f8_mapping_preview", lambda s, d: mappings.first_entries(K.mapping(entries(s, d)), 1), f"WITH {DICT_CTE} SELECT doc_id, placeholder, original FROM mapping QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord, placeholder) <= 1")
_built = lambda s, d: mappings.build(K.mapping(entries(s, d)), F.concat(F.col("doc_id").cast("string"), F.lit(".docx")), F.lit("2026-01-15T10:00:00Z"))
add("a9_mapping_source", lambda s, d: mappings.entries(mappings.from_json(mappings.to_json(_built(s, d)))), f"WITH {DICT_CTE} SELECT doc_id, placeholder, original FROM mapping")
add(
    "a8_mapping_json",
    lambda s, d: mappings.to_json(_built(s, d)).select("doc_id", F.get_json_object("json", "$.version").alias("version"), F.get_json_object("json", "$.original_file").alias("original_file")),
    f"WITH {DICT_CTE} SELECT DISTINCT doc_id, '1.0' AS version, CAST(doc_id AS VARCHAR) || '.docx' AS original_file FROM mapping",
)


def build_body(lines: list[str]) -> str:
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return f'<?xml version="1.0"?><w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>'


def build_docx(lines: list[str]) -> bytes:
    """A minimal document of these paragraphs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", build_body(lines))
    return out.getvalue()


def docx_files(s, d):
    """The contracts as (path, content) of Word files."""
    make = F.udf(lambda t: build_docx(t.split("\n")), "binary", useArrow=True)
    return contracts(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), make("text").alias("content"))


add("a1_docx_scan", lambda s, d: docx.paragraphs(docx_files(s, d)).select("path", "seq", "location", "text"), f"WITH {CONTRACTS_CTE} SELECT CAST(doc_id AS VARCHAR) || '.docx' AS path, CAST(seq - 1 AS BIGINT) AS seq, 'Paragraph ' || CAST(seq AS VARCHAR) AS location, text FROM paragraphs")
add("a4_docx_text", lambda s, d: docx.texts(docx.paragraphs(docx_files(s, d))), f"WITH {CONTRACTS_CTE} SELECT CAST(doc_id AS VARCHAR) || '.docx' AS path, text FROM contracts")
_MAGIC = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'D0CF11E0A1B1' WHEN 1 THEN '504B0304' ELSE '25504446' END AS bytes FROM {orders}"
add("a3_encryption_sniff", lambda s, d: view(_MAGIC, "orders")(s, d).select("doc_id", docx.is_ole2(F.unhex("bytes")).alias("ole2")), f"WITH m AS ({_MAGIC.format(orders='orders')}) SELECT doc_id, left(bytes, 8) = 'D0CF11E0' AS ole2 FROM m")
