"""Pieces of DuckDB SQL made from the registry of patterns."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def extract_sql(specs: list[tuple[str, str, int]]) -> str:
    """(doc_id, entity_type, match, family, pos) of all matches in {src}. Braces of patterns are doubled for format()."""
    parts = []
    for n, (t, p, g) in enumerate(specs):
        e = f"regexp_extract_all(text, {lit(p)}, {g})".replace("{", "{{").replace("}", "}}")
        parts.append(f"SELECT doc_id, {lit(t)} AS entity_type, unnest({e}) AS match, {n} AS family, generate_subscripts({e}, 1) - 1 AS pos FROM {{src}}")
    return " UNION ALL ".join(parts)
