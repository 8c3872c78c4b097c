"""Boolean trigram queries from regular expressions.

A query is a trigram (a string), or ``All`` or ``Any`` of queries; ``ANYTHING`` asks for nothing. Every
text that a regular expression matches holds what its query asks for, once both are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Alternative strings that are followed side by side, and characters of a class that are spelled out.
STRINGS, CHARACTERS = 64, 6
#: Repetitions that are spelled out; further ones ask for the same trigrams.
SPELLED = 4


@dataclass(frozen=True)
class All:
    parts: frozenset


@dataclass(frozen=True)
class Any:
    parts: frozenset


ANYTHING = All(frozenset())


def all_of(parts) -> object:
    flat = set()
    for p in parts:
        flat |= p.parts if isinstance(p, All) else {p}
    return next(iter(flat)) if len(flat) == 1 else All(frozenset(flat))


def any_of(parts) -> object:
    flat = set()
    for p in parts:
        flat |= p.parts if isinstance(p, Any) else {p}
    if not flat or ANYTHING in flat:
        return ANYTHING
    # what asks for all that another part asks for, and more, changes nothing
    sets = {p: frozenset({p}) if isinstance(p, str) else p.parts for p in flat if isinstance(p, str | All)}
    flat -= {p for p, own in sets.items() if any(other < own for other in sets.values())}
    return next(iter(flat)) if len(flat) == 1 else Any(frozenset(flat))


def named(query: object) -> frozenset[str]:
    """The trigrams that a query names."""
    return frozenset({query}) if isinstance(query, str) else frozenset(t for p in query.parts for t in named(p))


def flat(query: object) -> list[list[list[str]]]:
    """A query of three levels that asks for no more: all of these, any of those in each, all of the
    trigrams in each of them. What lies deeper is left out."""

    def must(q: object) -> list[str]:
        return [q] if isinstance(q, str) else sorted(p for p in q.parts if isinstance(p, str)) if isinstance(q, All) else []

    if isinstance(query, Any):
        ways = sorted(must(p) for p in query.parts)
        return [] if [] in ways else [ways]
    own = must(query)
    more = [] if isinstance(query, str) else [c for p in query.parts if isinstance(p, Any) for c in flat(p)]
    return ([[own]] if own else []) + sorted(more)


def holds(query: object, trigrams: set[str]) -> bool:
    if isinstance(query, str):
        return query in trigrams
    return (all if isinstance(query, All) else any)(holds(p, trigrams) for p in query.parts)


class Unknown(ValueError):
    """Syntax that isn't understood here; such a pattern asks for nothing."""


def query_of(pattern: str) -> object:
    """The query of a regular expression in Java's syntax."""
    try:
        reader = _Reader(pattern)
        whole = reader.alternatives()
        if reader.at < len(pattern):
            raise Unknown(pattern)
    except (ValueError, IndexError):
        return ANYTHING
    return whole.query()


@dataclass(frozen=True)
class _Part:
    """What is known of a piece of a pattern: all strings that it may match, or else a query."""

    strings: frozenset[str] | None
    asks: object = ANYTHING

    def query(self) -> object:
        return self.asks if self.strings is None else _strings_query(self.strings)


_EMPTY, _GAP = _Part(frozenset({""})), _Part(None)


def _strings_query(strings) -> object:
    return any_of(all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _in_turn(parts: list[_Part]) -> _Part:
    """Parts one after another. Strings are joined while they are few; where they aren't, their last
    two characters go on, so that trigrams across the joint are asked for."""
    run, asked, whole = frozenset({""}), [], True
    for p in parts:
        if p.strings is None:
            asked += [_strings_query(run), p.asks]
            run, whole = frozenset({""}), False
            continue
        if len(run) * len(p.strings) > STRINGS:
            asked.append(_strings_query(run))
            run, whole = frozenset(s[-2:] for s in run), False
            if len(run) * len(p.strings) > STRINGS:
                run = frozenset({""})
        run = frozenset(a + b for a in run for b in p.strings)
    return _Part(run) if whole else _Part(None, all_of([*asked, _strings_query(run)]))


def _one_of(parts: list[_Part]) -> _Part:
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*(p.strings for p in parts))
        if len(strings) <= STRINGS:
            return _Part(strings)
    return _Part(None, any_of(p.query() for p in parts))


def _repeated(part: _Part, least: int, most: int | None) -> _Part:
    if least == 0:
        return _one_of([part, _EMPTY]) if most == 1 and part.strings is not None else _GAP
    copies = [part] * min(least, SPELLED)
    return _in_turn(copies if most == least <= SPELLED else [*copies, _GAP])


class _Reader:
    """Recursive descent over a pattern. Case is folded throughout, so flags of case change nothing."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def ahead(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.ahead(s):
            self.at += len(s)
            return True
        return False

    def until(self, s: str) -> str:
        end = self.text.find(s, self.at)
        if end < 0:
            raise Unknown(self.text)
        found, self.at = self.text[self.at : end], end + len(s)
        return found

    def alternatives(self) -> _Part:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return _one_of(parts)

    def sequence(self) -> _Part:
        parts = []
        while self.at < len(self.text) and not self.ahead("|") and not self.ahead(")"):
            parts.append(self.quantified(self.atom()))
        return _in_turn(parts)

    def quantified(self, part: _Part) -> _Part:
        while True:
            if self.take("*"):
                least, most = 0, None
            elif self.take("+"):
                least, most = 1, None
            elif self.take("?"):
                least, most = 0, 1
            elif self.take("{"):
                low, comma, high = self.until("}").partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                return part
            self.take("?") or self.take("+")  # lazy or possessive: the same strings, or fewer
            part = _repeated(part, least, most)

    def atom(self) -> _Part:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.characters()
        if c == "\\":
            return self.escape()
        if c == ".":
            return _GAP
        if c in "^$":
            return _EMPTY
        return self.literal(c)

    @staticmethod
    def literal(c: str) -> _Part:
        return _Part(frozenset({c.lower()})) if c.isascii() else _GAP

    def group(self) -> _Part:
        aside = False
        if self.take("?"):
            if self.take("=") or self.take("!") or self.take("<=") or self.take("<!"):
                aside = True
            elif self.take("<"):
                self.until(">")
            elif not (self.take(":") or self.take(">")):
                start = self.at
                while self.text[self.at] in "idmsu-":
                    self.at += 1
                flags = self.text[start : self.at]
                if "u" in flags or not (self.ahead(")") or self.ahead(":")):
                    raise Unknown(self.text)  # case beyond ASCII, comments, or no flags at all
                if self.take(")"):
                    return _EMPTY
                self.take(":")
        part = self.alternatives()
        if not self.take(")"):
            raise Unknown(self.text)
        return _EMPTY if aside else part

    def escape(self) -> _Part:
        c = self.text[self.at]
        self.at += 1
        if c == "Q":
            return _in_turn([self.literal(x) for x in self.until("\\E")])
        if c in "bBAGzZ":
            return _EMPTY
        if c in "dDwWsShHvVRX" or c.isdigit():
            return _GAP
        if c in "pP":
            if self.take("{"):
                self.until("}")
            else:
                self.at += 1
            return _GAP
        if c == "k" and self.take("<"):
            self.until(">")
            return _GAP
        code = self.code(c)
        return _GAP if code is None else self.literal(code)

    def code(self, c: str) -> str | None:
        """The character of an escape."""
        if c in "xu":
            n = 2 if c == "x" else 4
            if self.ahead("{"):
                raise Unknown(self.text)
            self.at += n
            return chr(int(self.text[self.at - n : self.at], 16))
        if c in "tnrfae":
            return {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}[c]
        if c.isalnum():
            raise Unknown(self.text)
        return c

    def characters(self) -> _Part:
        """A class in brackets: its characters if they are few, else a gap."""
        found, many, last = set(), self.take("^"), None
        first = True
        while first or not self.take("]"):
            first = False
            c = self.text[self.at]
            self.at += 1
            if c == "[" or (c == "&" and self.ahead("&")):
                raise Unknown(self.text)
            if c == "\\":
                e = self.text[self.at]
                self.at += 1
                if e in "dDwWsShHvV":
                    many, last = True, None
                    continue
                if e in "pPQ":
                    raise Unknown(self.text)
                c = self.code(e)
            elif c == "-" and last is not None and not self.ahead("]"):
                end = self.text[self.at]
                self.at += 1
                if end == "[":
                    raise Unknown(self.text)
                if end == "\\":
                    self.at += 1
                    end = self.code(self.text[self.at - 1])
                if ord(end) - ord(last) > 2 * CHARACTERS or not end.isascii():
                    many = True
                else:
                    found |= {chr(x).lower() for x in range(ord(last), ord(end) + 1)}
                last = None
                continue
            if not c.isascii():
                many = True
            found.add(c.lower())
            last = c
        return _GAP if many or len(found) > CHARACTERS else _Part(frozenset(found))
