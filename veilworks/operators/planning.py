"""What one document's cloaking does, worked out within its row: its keys, its mapping, its file name and its text.

The same rules as those of the relational steps in `dictionary`, in their order. All that a document needs is
in its row, so no step deals texts or keys out, and nothing is kept on disk between steps."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from veilworks.functions import patterns as P
from veilworks.functions.rewriter import Rewriter  # noqa: F401

#: White space of java.util.regex with Unicode classes, and what may stand for a blank in a file name.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = r"[ \t\n\x0b\f\r_\-.]?"
_STRIP = re.compile(P.STRIP_SUFFIX)
_INITIAL = re.compile(r"^[A-Z]\.?$")
_KIND = {k: re.compile(rf"^\[{k}-\d+\]$", re.ASCII) for k in ("Person", "Company")}
_MONTHS, _STOP, _SMALL = frozenset(P.MONTH_NAMES), frozenset(P.COMPANY_STOP), frozenset(P.INITIALISM_STOP)
#: Short forms and derived keys come behind this many entries.
BEHIND = 1_000_000


class Steps(NamedTuple):
    """known and keys: (original, placeholder) in order, with the names' placeholders and with placeholders of their own; mapping: (ord, placeholder, original)."""

    known: list[tuple[str, str]]
    keys: list[tuple[str, str]]
    mapping: list[tuple[int, str, str]]


@lru_cache(maxsize=1 << 14)
def stripped(name: str) -> str:
    return _STRIP.sub("", name).strip(" ")


@lru_cache(maxsize=1 << 14)
def suffix_forms(name: str) -> tuple[str, ...]:
    """The names that stripping one corporate suffix after another gives, longest first."""
    out, last = [], name
    while (form := stripped(last)) not in ("", last):
        if form != name:
            out.append(form)
        last = form
    return tuple(dict.fromkeys(out))


def words(name: str) -> list[str]:
    return [w for w in _WHITE.split(name) if w]


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_" if c < "\x80" else unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc") or c in "\u200c\u200d"


def _edge(text: str, i: int) -> bool:
    return (i > 0 and _letter(text[i - 1])) != (i < len(text) and _letter(text[i]))


def whole_word(text: str, part: str) -> bool:
    i = text.find(part)
    while i >= 0:
        if _edge(text, i) and _edge(text, i + len(part)):
            return True
        i = text.find(part, i + 1)
    return False


@lru_cache(maxsize=1 << 14)
def phrases(parts: tuple[str, ...]) -> tuple[str, ...]:
    """All contiguous runs of parts shorter than the whole, by length and place."""
    n = len(parts)
    return tuple(" ".join(parts[i : i + k]) for k in range(1, n) for i in range(n - k + 1))


def _person_forms(name: str) -> list[str]:
    parts = [w for w in words(name) if not _INITIAL.match(w)]
    forms = dict.fromkeys([*phrases(tuple(parts)), f"{parts[0]} {parts[-1]}"]) if len(parts) > 1 else ()
    return [x for x in forms if len(x) >= 3 and x not in _MONTHS]


def _company_forms(name: str) -> list[str]:
    return [x for x in phrases(tuple(words(name))) if len(x) >= 3 and (" " in x or x.lower() not in _STOP)]


def worked_out(entries: list[tuple[str, str]], shorts: list[tuple[str, str]], text: str | None) -> Steps:
    """entries (placeholder, original) in their order, of which later ones win; shorts (original, placeholder) of a configuration."""
    base: dict = {}
    for i, (placeholder, original) in enumerate(entries):
        if original:
            base.setdefault(placeholder, [i, original])[1] = original
    inverse: dict[str, str] = {}
    for placeholder, (_, original) in base.items():
        inverse[original] = placeholder
    originals = frozenset(inverse)
    for original, placeholder in shorts:
        if original and original not in inverse:
            inverse[original] = placeholder
    grown = dict(inverse)
    for original, placeholder in inverse.items():
        for form in suffix_forms(original):
            grown.setdefault(form, placeholder)
    lines: dict[str, str] = {}
    for original, placeholder in grown.items():
        for line in [x.strip(" ") for x in original.split("\n")] if "\n" in original else [original]:
            if line:
                lines.setdefault(line, placeholder)
    known = dict(lines)
    if text is not None:
        for kind, forms in (("Person", _person_forms), ("Company", _company_forms)):
            before, start = dict(known), f"[{kind}-"
            for original, placeholder in lines.items():
                if placeholder and placeholder.startswith(start) and _KIND[kind].match(placeholder):
                    for x in forms(original):
                        if x not in before and x not in known and (whole_word(text, x) or (kind == "Person" and whole_word(text, x.upper()))):
                            known[x] = placeholder
    keys, used = [], {}
    for original, placeholder in known.items():
        if original not in originals and placeholder is not None:
            name = _next_short(placeholder, base, used)
            keys.append((original, name))
        else:
            keys.append((original, placeholder))
    mapping = [(i, placeholder, original) for placeholder, (i, original) in base.items()]
    mapping += [(BEHIND + 1 + n, placeholder, original) for n, (original, placeholder) in enumerate(keys) if original not in originals]
    return Steps(list(known.items()), keys, mapping)


def _next_short(placeholder: str, taken: dict, used: dict[str, int]) -> str:
    """[X-Short], [X-Short-2] and so on, without those that the mapping has."""
    i = used.get(placeholder, 0)
    while True:
        i += 1
        name = f"{placeholder[:-1]}-Short{'' if i == 1 else f'-{i}'}]"
        if name not in taken:
            used[placeholder] = i
            return name


@lru_cache(maxsize=1 << 10)
def _name_pattern(key: str) -> re.Pattern:
    return re.compile(_SEPARATOR.join(re.escape(x) for x in key.split(" ")), re.IGNORECASE)


@lru_cache(maxsize=1 << 14)
def _name_keys(original: str) -> tuple:
    """(-length, key, what a plain name must hold to match) of an original and of its form without suffix."""
    return tuple((-len(x), x, tuple(x.lower().split(" ")) if x.isascii() else ()) for x in (original, stripped(original)) if x)


def clean_name(name: str | None, known: list[tuple[str, str]]) -> str | None:
    """A file's name with known originals, and their forms without suffix, by their placeholders, longest first; blanks match any separator."""
    if not name or not known:
        return name
    at = name.rfind(".")
    stem, suffix = (name, "") if at < 0 else (name[:at], name[at:])
    both = [(n, key, p, parts) for o, p in known if p is not None for n, key, parts in _name_keys(o)]
    both.sort()
    low, plain = stem.lower(), stem.isascii()
    for _, key, placeholder, parts in both:
        if plain and parts:
            for x in parts:
                if x not in low:
                    break
            else:
                parts = ()
            if parts:
                continue
        stem = _name_pattern(key).sub(lambda _, p=placeholder: p, stem)
        low, plain = stem.lower(), stem.isascii()
    return stem + suffix


@lru_cache(maxsize=1 << 14)
def initialisms(name: str) -> tuple[str, ...]:
    """The initials of a name's significant words, and without the last word, of two letters or more."""
    parts = [w for w in words(stripped(name)) if w.lower() not in _SMALL]
    if len(parts) < 2:
        return ()
    full = "".join(w[0].upper() for w in parts)
    return tuple(x for x in ([full, full[:-1]] if len(parts) > 2 else [full]) if len(x) >= 2)


def comment_words(keys: list[tuple[str, str]], text: str | None) -> list[tuple[str, str]]:
    """What is replaced in comments: the keys, their forms without suffixes, and the initialisms that the text holds in any case; first names win."""
    wide = {original: (n, placeholder) for n, (original, placeholder) in enumerate(keys)}
    upper, have = (text or "").upper(), frozenset(wide)
    for n, (original, placeholder) in enumerate(keys):
        for form in suffix_forms(original):
            wide.setdefault(form, (n, placeholder))
    for n, (original, placeholder) in enumerate(keys):
        for x in initialisms(original):
            if x not in have and x in upper:
                wide.setdefault(x, (n, placeholder))
    return [(k, p) for _, k, p in sorted((n, k, p) for k, (n, p) in wide.items() if p is not None)]
