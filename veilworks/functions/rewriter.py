"""All keys of a lookup replaced in a text in one pass."""

from __future__ import annotations

import re

#: Characters outside ASCII that match an ASCII letter in any case; one of them has a longer lower case.
_ODD = re.compile("[\u0130\u0131\u017f\u212a]")


class Rewriter:
    """All keys of a lookup replaced at once, leftmost first, the longest first, in any case; of keys that differ in case only, the last counts.

    An alternation of a document's own keys costs more to compile than its text to read; keys of ASCII are
    looked up in the lower-cased text instead, unless the text holds a character that ASCII letters match."""

    def __init__(self, lookup) -> None:
        self.keys = {k.lower(): v for k, v in lookup if k}
        self.plain = all(k.isascii() for k in self.keys)
        self._pattern = None

    def within(self, text: str) -> Rewriter:
        """The rewriter of the keys that a text holds, for its parts."""
        if not self.plain or (not text.isascii() and _ODD.search(text)):
            return self
        low = text.lower()
        return Rewriter([(k, v) for k, v in self.keys.items() if k in low])

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self.plain or (not text.isascii() and _ODD.search(text)):
            if self._pattern is None:
                self._pattern = re.compile("|".join(re.escape(k) for k in sorted(self.keys, key=len, reverse=True)), re.IGNORECASE)
            return [m.span() for m in self._pattern.finditer(text)]
        low, hits = text.lower(), []
        for k in self.keys:
            i = low.find(k)
            while i >= 0:
                hits.append((i, -len(k)))
                i = low.find(k, i + 1)
        if not hits:
            return hits
        hits.sort()
        out, at = [], 0
        for i, n in hits:
            if i >= at:
                at = i - n
                out.append((i, at))
        return out

    def __call__(self, text: str) -> tuple[str, int]:
        """The text after replacement and the number of matches; a match that the lookup lacks stays."""
        spans = self.spans(text) if self.keys else ()
        if not spans:
            return text, 0
        out, at = [], 0
        for a, b in spans:
            new = self.keys.get(text[a:b].lower())
            out += (text[at:a], text[a:b] if new is None else new)
            at = b
        out.append(text[at:])
        return "".join(out), len(spans)
