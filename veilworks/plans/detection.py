"""Queries on entity detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilworks.functions import patterns as P
from veilworks.operators import detect as D
from veilworks.plans.contracts import CONTRACTS_CTE, contracts
from veilworks.plans.sql import extract_sql, lit

QUERIES, SQL = {}, {}


def source(table: str, key: str, text: str = "text"):
    return lambda spark, d: spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def counts_sql(body: str, src: str, cte: str = "") -> str:
    return f"WITH {cte}{',' if cte else ''} m AS ({body.format(src=src)}) SELECT doc_id, entity_type, match AS text, count(*) AS count FROM m GROUP BY ALL"


# single detectors: each over contracts, and those that occur there over documents, pages and conversations
_documents, _pages, _talk = source("documents", "doc_id"), source("pages", "page_id", "html"), source("conversations", "conv_id")
for _n, (_t, _p, _g) in enumerate(P.STRUCTURED):
    _name = f"h{_n + 1}_{_t.lower()}"
    _re2 = P.STRUCTURED_RE2[_n]
    add(_name, lambda s, d, x=(_t, _p, _g): D.count_matches(D.extract(contracts(s, d), [x])), counts_sql(extract_sql([_re2]), "contracts", CONTRACTS_CTE))
for _t, _p, _g in (P.STRUCTURED[0], P.STRUCTURED[1], P.STRUCTURED[6]):
    _re2 = next(x for x in P.STRUCTURED_RE2 if x[0] == _t)
    for _label, _src, _view in (("documents", _documents, "(SELECT doc_id, text FROM documents)"), ("pages", _pages, "(SELECT page_id AS doc_id, html AS text FROM pages)")):
        add(f"d1_{_t.lower()}_{_label}", lambda s, d, x=(_t, _p, _g), f=_src: D.count_matches(D.extract(f(s, d), [x])), counts_sql(extract_sql([_re2]), _view))

STRUCTURED_CTE = (
    "found AS (" + extract_sql(P.STRUCTURED_RE2) + "),\ncounts AS (SELECT doc_id, entity_type, match AS text, count(*) AS count FROM found GROUP BY ALL),\n"
    "structured AS (SELECT * FROM counts u WHERE NOT (entity_type = 'URL' AND EXISTS (SELECT 1 FROM counts e WHERE e.doc_id = u.doc_id AND e.entity_type = 'EMAIL' AND contains(e.text, u.text))))"
)
for _label, _src, _view in (
    ("documents", _documents, "documents"), ("pages", _pages, "(SELECT page_id AS doc_id, html AS text FROM pages)"), ("conversations", _talk, "(SELECT conv_id AS doc_id, text FROM conversations)"), ("contracts", contracts, "contracts")
):
    add(
        f"c1_structured_{_label}",
        lambda s, d, f=_src: D.structured(f(s, d)),
        f"WITH {CONTRACTS_CTE + ',' if _label == 'contracts' else ''} {STRUCTURED_CTE.format(src=_view)} SELECT * FROM structured",
    )
add(
    "e1_numbering",
    lambda s, d: D.number(D.structured(_documents(s, d))),
    f"WITH {STRUCTURED_CTE.format(src='documents')} SELECT *, '[' || upper(left(entity_type, 1)) || lower(substr(entity_type, 2)) || '-' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY count DESC, text) || ']' AS placeholder FROM structured",
)

_STOP = "[" + ", ".join(lit(w) for w in P.PERSON_STOP) + "]"
_PEOPLE = f"SELECT doc_id, entity_type, trim(match, ' ' || chr(10)) AS match, family, pos FROM ({extract_sql([('PERSON', p, 1) for p in P.PERSON.values()])})"
PEOPLE_CTE = f"people AS (SELECT * FROM ({_PEOPLE}) WHERE NOT regexp_matches(match, '^[a-z]') AND NOT list_has_any(string_split_regex(match, '\\s+'), {_STOP}))"
DATES_CTE = "dates AS (" + extract_sql([("DATE", p, 0) for p in P.DATE.values()]) + ")"
add("h9_person", lambda s, d: D.count_matches(D.people(contracts(s, d))), f"WITH {CONTRACTS_CTE}, {PEOPLE_CTE.format(src='contracts')} SELECT doc_id, entity_type, match AS text, count(*) AS count FROM people GROUP BY ALL")
for _k, _p in P.PERSON.items():
    add(_k, lambda s, d, p=_p: D.count_matches(D.extract(contracts(s, d), [("PERSON", p, 1)])), counts_sql(extract_sql([("PERSON", _p, 1)]), "contracts", CONTRACTS_CTE))
add("h10_date", lambda s, d: D.count_matches(D.dates(contracts(s, d))), f"WITH {CONTRACTS_CTE}, {DATES_CTE.format(src='contracts')} SELECT doc_id, entity_type, match AS text, count(*) AS count FROM dates GROUP BY ALL")
for _k, _p in P.DATE.items():
    add(_k, lambda s, d, p=_p: D.count_matches(D.extract(contracts(s, d), [("DATE", p, 0)])), counts_sql(extract_sql([("DATE", _p, 0)]), "contracts", CONTRACTS_CTE))
for _k, _p in P.CITY_STATE.items():
    add(_k, lambda s, d, p=_p: D.count_matches(D.extract(contracts(s, d), [("ADDRESS", p, 1)])), counts_sql(extract_sql([("ADDRESS", _p, 1)]), "contracts", CONTRACTS_CTE))


def _canonical(table: str) -> str:
    return f"SELECT doc_id, entity_type, arg_min(match, family * 1000000 + pos) AS text, count(*) AS count FROM {table} GROUP BY doc_id, entity_type, lower(match)"


_BARE = lit(P.BARE_SUFFIX)
_COMPANY_TAIL = lit(P.COMPANY + r"((?:[A-Za-z]|\s+[A-Za-z]+)?)")
_TERMS = ", ".join(lit(w) for w in P.AGREEMENT_TERMS)
_ABBREVIATIONS = ", ".join(lit(w) for w in P.LEGAL_ABBREVIATIONS)
ALL_CTE = f"""{{structured}}, {PEOPLE_CTE}, {DATES_CTE},
address AS (SELECT doc_id, text FROM structured WHERE entity_type = 'ADDRESS'),
city_raw AS (SELECT doc_id, entity_type, trim(match, ' ' || chr(10)) AS match, family, pos FROM ({extract_sql([('ADDRESS', p, 1) for p in P.CITY_STATE.values()])})),
city_free AS (SELECT * FROM city_raw c WHERE NOT EXISTS (SELECT 1 FROM address a WHERE a.doc_id = c.doc_id AND contains(a.text, c.match))),
cities AS ({_canonical('city_free')}),
address2 AS (SELECT doc_id, text FROM address UNION ALL SELECT doc_id, text FROM cities),
road_raw AS (SELECT doc_id, entity_type, trim(match, ' ' || chr(10)) AS match, family, pos FROM ({extract_sql([('ADDRESS', P.STREET, 1)])})),
road_free AS (SELECT * FROM road_raw c WHERE NOT EXISTS (SELECT 1 FROM address2 a WHERE a.doc_id = c.doc_id AND (contains(a.text, c.match) OR contains(c.match, a.text)))),
roads AS ({_canonical('road_free')}),
bare AS (SELECT DISTINCT x.doc_id, 'AMOUNT' AS entity_type, x.match AS text, (length(t.text) - length(replace(t.text, x.match, ''))) // length(x.match) AS count
  FROM ({extract_sql([('AMOUNT', P.BARE_AMOUNT, 1)])}) x JOIN {{src}} t USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM structured a WHERE a.doc_id = x.doc_id AND a.entity_type = 'AMOUNT' AND a.text = x.match)),
company_raw AS (SELECT doc_id, pos, rtrim(rtrim(trim(raw), ','), '.') AS match, tail FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, {_COMPANY_TAIL}, 1)) AS raw, unnest(regexp_extract_all(text, {_COMPANY_TAIL}, 2)) AS tail,
         generate_subscripts(regexp_extract_all(text, {_COMPANY_TAIL}, 1), 1) AS pos FROM {{src}})),
company_ok AS (SELECT doc_id, 'COMPANY' AS entity_type, 0 AS family, pos, match FROM company_raw
  WHERE NOT regexp_matches(tail, '^[A-Za-z]') AND NOT lower(trim(tail, ' ' || chr(10))) IN ({_TERMS}) AND trim(regexp_replace(match, {_BARE}, '')) <> ''
    AND NOT regexp_matches(match, {lit(P.DETERMINER)}) AND NOT starts_with(match, 'Dear ') AND NOT regexp_replace(match, '[\\s,.\\-]+', '', 'g') IN ({_ABBREVIATIONS})),
companies AS ({_canonical('company_ok')}),
every AS (
  SELECT doc_id, entity_type, text, 1.0::DOUBLE AS confidence, count, CAST(list_position(['EMAIL','PHONE','SSN','EIN','AMOUNT','ADDRESS','URL'], entity_type) - 1 AS INTEGER) AS ord FROM structured
  UNION ALL SELECT doc_id, entity_type, match, 1.0, count(*), 7 FROM people GROUP BY doc_id, entity_type, match
  UNION ALL SELECT doc_id, entity_type, match, 1.0, count(*), 8 FROM dates GROUP BY doc_id, entity_type, match
  UNION ALL SELECT doc_id, entity_type, text, 0.9, count, 9 FROM cities
  UNION ALL SELECT doc_id, entity_type, text, 0.9, count, 10 FROM roads
  UNION ALL SELECT doc_id, entity_type, text, 0.9, count, 11 FROM bare
  UNION ALL SELECT doc_id, entity_type, text, 1.0, count, 12 FROM companies),
merged AS (SELECT doc_id, entity_type, text, CAST(sum(count) AS BIGINT) AS count, max(confidence) AS confidence, min(ord) AS ord FROM every GROUP BY doc_id, entity_type, text),
winners AS (SELECT * EXCLUDE (_win) FROM (SELECT *, first_value(entity_type) OVER (PARTITION BY doc_id, lower(text) ORDER BY confidence DESC, ord, text) AS _win FROM merged) WHERE _win = entity_type)"""
CONTRACT_ALL = f"WITH {CONTRACTS_CTE}, " + ALL_CTE.replace("{structured}", STRUCTURED_CTE).replace("{src}", "contracts").replace("{{", "{").replace("}}", "}")
_NUMBERED = "SELECT doc_id, entity_type, text, count, confidence, '[' || upper(left(entity_type, 1)) || lower(substr(entity_type, 2)) || '-' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY count DESC, text) || ']' AS placeholder FROM "


add("h11_city_state", lambda s, d: D.locations(contracts(s, d)), CONTRACT_ALL + " SELECT doc_id, entity_type, text, count FROM cities")
add("h12_street", lambda s, d: D.streets(contracts(s, d)), CONTRACT_ALL + " SELECT doc_id, entity_type, text, count FROM roads")
add("h8_bare_amount", lambda s, d: D.bare_amounts(contracts(s, d)), CONTRACT_ALL + " SELECT doc_id, entity_type, text, CAST(count AS BIGINT) AS count FROM bare")
add("h13_company", lambda s, d: D.companies(contracts(s, d)), CONTRACT_ALL + " SELECT doc_id, entity_type, text, count FROM companies")
add("h19_detect_regex", lambda s, d: D.detect_regex(contracts(s, d)), CONTRACT_ALL + " SELECT doc_id, entity_type, text, confidence, CAST(count AS BIGINT) AS count, ord FROM every")
add("d4_dedup", lambda s, d: D.deduplicated(contracts(s, d)), CONTRACT_ALL + " SELECT * FROM merged")
add("e3_cross_type", lambda s, d: D.typed(contracts(s, d)), CONTRACT_ALL + " SELECT * FROM winners")
add("h20_detect", lambda s, d: D.detect(contracts(s, d)), CONTRACT_ALL + " " + _NUMBERED + "winners")

# parties: on these contracts a name and its label stand together, so RE2 finds both in one match
_DEFINED_SQL = lit(P.COMPANY + r"\s+\((?:the\s+)?\"([^\",]+)\"")
PARTY_CTE = f"""party_raw AS (SELECT doc_id, unnest(regexp_extract_all(left(text, 2000), {_DEFINED_SQL}, 1)) AS name, unnest(regexp_extract_all(left(text, 2000), {_DEFINED_SQL}, 2)) AS label,
  generate_subscripts(regexp_extract_all(left(text, 2000), {_DEFINED_SQL}, 1), 1) AS pos FROM contracts),
party_seen AS (SELECT * FROM party_raw QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) = 1),
party_role AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, lower(trim(regexp_replace(name, {lit(P.STRIP_SUFFIX)}, ''))) AS core,
  array_to_string(list_transform(list_filter(string_split(name, ' '), lambda w: regexp_matches(w, '^[A-Z]')), lambda w: left(w, 1)), '') AS initials FROM party_seen),
parties AS (SELECT doc_id, ord, name, CASE WHEN short THEN CASE ord WHEN 1 THEN 'Company' ELSE 'Counterparty' END ELSE label END AS label, CASE WHEN short THEN label END AS defined_term FROM (
  SELECT *, lower(label) = core OR lower(label) = lower(name) OR starts_with(core, lower(label) || ' ') OR (label = upper(label) AND label <> lower(label) AND length(label) <= 10) OR upper(initials) = upper(label) AS short FROM party_role))"""
add("h21_parties", lambda s, d: D.parties(contracts(s, d)), f"WITH {CONTRACTS_CTE}, {PARTY_CTE} SELECT * FROM parties")
add(
    "b11_party_exclusion",
    lambda s, d: (lambda c: D.detect(c, D.parties(c)))(contracts(s, d)),
    CONTRACT_ALL + f", {PARTY_CTE} " + _NUMBERED + "winners w WHERE NOT EXISTS (SELECT 1 FROM parties p WHERE p.doc_id = w.doc_id AND rtrim(lower(p.name), '.,') = rtrim(lower(w.text), '.,'))",
)
