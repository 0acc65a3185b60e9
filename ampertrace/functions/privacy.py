"""Finding and masking personal and client names in text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ampertrace.functions.text import as_column, strip

# Characters and patterns.
LOWER = "a-ząćęłńóśźż"
UPPER = "A-ZĄĆĘŁŃÓŚŹŻ"
HYPHENS = "-‐‑‒–—−"
SOFT_HYPHEN = "­"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
PHONE = r"(\+?\(?\d{1,4}\)?[\s\-]?\d{1,4}[\s\-]?\d{1,4}[\s\-]?\d{1,4})"
COMMA_NAME = r"(?U)(?<!\w)([A-Z][a-z]+(?:-[A-Z][a-z]+)*)\s*,\s*([A-Z][a-z]+(?:-[A-Z][a-z]+)*)(?!\w)"
CAMEL_NAME = rf"(?U)\b[{UPPER}][{LOWER}]+(?:[{UPPER}][{LOWER}]+)+\b"
NOISE_PREFIX = r"(?mdU)^\s*(?:[\-•‣▪●·]+|\d{1,3}[.)]|[|/])\s+(?=\w)"
ISO_DATE = r"\b(19|20)\d\d[\-/.‐‑‒–—−](0[1-9]|1[0-2])[\-/.‐‑‒–—−](0[1-9]|[12]\d|3[01])\b"
IDENTIFIER = r"[A-Za-z]{2,10}[_\-‐-—−]?\d{3,}"
TOKEN_CHARS = r"A-Za-z0-9_\-‐-—−"
MAIL_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-"
MAIL_HOST = r"[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
MARKS = {"email": "mail@mail.com", "phone": "phone number", "client": "Client", "person": "Name"}


def emails(c: Column | str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(EMAIL), F.lit(0))


def preclean(c: Column | str) -> Column:
    """Without list bullets, with a space between glued words, on one line."""
    text = F.regexp_replace(as_column(c), NOISE_PREFIX, "")
    text = F.regexp_replace(text, f"([{LOWER}])([{UPPER}])", "$1 $2")
    text = F.regexp_replace(text, r"[ \t]*[\r\n]+[ \t]*", " ")
    return strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def client_marker(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"[\s-]+", " ")))


def person_like(c: Column | str) -> Column:
    """Names written "Surname, Given" or glued in CamelCase, sorted."""
    text = as_column(c)
    pairs = F.transform(
        F.regexp_extract_all(preclean(text), F.lit(COMMA_NAME), F.lit(0)),
        lambda m: F.concat_ws(", ", F.regexp_extract(m, COMMA_NAME, 1), F.regexp_extract(m, COMMA_NAME, 2)),
    )
    pairs = F.filter(pairs, lambda p: ~F.lower(p).startswith("name,"))
    glued = F.transform(
        F.regexp_extract_all(text, F.lit(CAMEL_NAME), F.lit(0)),
        lambda w: F.array_join(F.regexp_extract_all(w, F.lit(f"[{UPPER}][{LOWER}]+"), F.lit(0)), " "),
    )
    return F.array_sort(F.array_distinct(F.concat(pairs, glued)))


def without_soft_hyphens(c: Column | str) -> Column:
    return F.translate(as_column(c), SOFT_HYPHEN, "")


def folded_words(c: Column | str) -> Column:
    """Distinct words in one case, the keys under which names are looked up."""
    folded = F.lower(F.upper(without_soft_hyphens(c)))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


# ---- one text at a time: helpers of the Arrow passes ---------------------------------------------

_PHONE = re.compile(PHONE)
_IDENTIFIER = re.compile(rf"(?<![{TOKEN_CHARS}]){IDENTIFIER}(?![{TOKEN_CHARS}])")
_DATE_LIKE = re.compile(rf"{ISO_DATE}|^[^\s-]{{4}}[\s-][^\s-]{{2}}[\s-][^\s-]{{2}}$")
_MAIL_HOST = re.compile(MAIL_HOST)
_BROKEN = re.compile(rf"(?<=\w[{re.escape(HYPHENS)}])\s+(?=\w)")
_ALIKE = {ord(h): "-" for h in HYPHENS}
_WORD = re.compile(r"\w+|[^\w\s-]")
_JOINT = re.compile(r"\s*-\s*|\s+")
#: kinds of finds; where finds overlap, the earliest kind names the whole
KINDS = ("email", "phone", "client", "person")


def phone_spans(text: str) -> list[tuple[int, int]]:
    """Places of phone-like digit groups that are no dates and do not lie in an identifier."""
    identifiers = [m.span() for m in _IDENTIFIER.finditer(text)]
    found, k = [], 0
    for match in _PHONE.finditer(text):
        start, end = match.span()
        while k < len(identifiers) and identifiers[k][1] <= start:
            k += 1
        inside = k < len(identifiers) and identifiers[k][0] <= start and end <= identifiers[k][1]
        if not inside and sum(map(str.isdigit, match.group())) >= 7 and not _DATE_LIKE.search(match.group()):
            found.append((start, end))
    return found


def phones(c: Column | str) -> Column:
    """Phone numbers in order. Texts without a long enough digit run do not go to Python."""
    text = as_column(c)
    find = F.pandas_udf(
        lambda texts: texts.map(lambda t: [] if t is None else [t[s:e] for s, e in phone_spans(t)]), "array<string>"
    )
    return find(F.when(text.rlike("(?U)" + PHONE), text))


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of e-mail addresses, in one pass from one @ to the next."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(MAIL_CHARS))
        host = _MAIL_HOST.match(text, at + 1)
        if start < at and host:
            yield start, host.end()
        floor = host.end() if start < at and host else at + 1
        at = text.find("@", floor)


def plain_text(text: str) -> tuple[str, Sequence[int]]:
    """The text without soft hyphens and without line breaks after a hyphen, and where each character stood."""
    places: Sequence[int] = range(len(text))
    if SOFT_HYPHEN in text:
        places = [i for i, ch in enumerate(text) if ch != SOFT_HYPHEN]
        text = text.replace(SOFT_HYPHEN, "")
    gaps = [m.span() for m in _BROKEN.finditer(text) if "\n" in m.group()]
    if gaps:
        edges = [0, *chain.from_iterable(gaps), len(text)]
        kept = [slice(s, e) for s, e in zip(edges[::2], edges[1::2])]
        places = [p for k in kept for p in places[k]]
        text = "".join(text[k] for k in kept)
    return text, places


#: names of which a task keeps the words
NAMES_KEPT = 20_000


class Words:
    """The words and signs of a text, by which names are found.

    The words of a name may be joined by any hyphen or by spaces. A name does not begin or end inside a word, and a
    name of one part is not followed by a hyphen.
    """

    def __init__(self, plain: str):
        self.text = plain.translate(_ALIKE)
        self.spans = [m.span() for m in _WORD.finditer(self.text)]
        self.given = [self.text[s:e] for s, e in self.spans]
        self.folded = [w.casefold() for w in self.given]
        self.first: dict[str, list[int]] = defaultdict(list)
        for i, word in enumerate(self.folded):
            self.first[word].append(i)

    def gap(self, i: int) -> str:
        """How word i is tied to the one before: "" (touching), "-" (joined), "?" (else)."""
        between = self.text[self.spans[i - 1][1] : self.spans[i][0]]
        return "" if not between else "-" if _JOINT.fullmatch(between) else "?"

    def find(self, name: Words, fold: bool) -> Iterator[tuple[int, int]]:
        count = len(name.spans)
        ties = ["-" if name.gap(j) else "" for j in range(1, count)]
        forbidden = r"[\w-]" if "-" not in ties else r"\w"
        own, wanted = (self.folded, name.folded) if fold else (self.given, name.given)
        for i in self.first.get(name.folded[0], ()) if count else ():
            if own[i : i + count] != wanted or any(self.gap(i + j) != tie for j, tie in enumerate(ties, 1)):
                continue
            start, end = self.spans[i][0], self.spans[i + count - 1][1]
            if not re.match(r"\w", self.text[start - 1 : start]) and not re.match(forbidden, self.text[end : end + 1]):
                yield start, end


def pattern_of(text: str, fold: bool, literal: bool) -> re.Pattern:
    """A free pattern of the dictionary, or a name made of signs only. A pattern that is none is an error."""
    try:
        return re.compile(rf"(?<!\w){re.escape(text)}(?!\w)" if literal else text, re.IGNORECASE if fold else 0)
    except re.error as e:
        raise ValueError(f"client pattern {text!r}: {e}") from e


def pattern_hits(text: Column, patterns: list[tuple[str, re.Pattern]]) -> Column:
    """Places in the plain text at which free patterns match, with the client of each."""

    def hits(t: str | None) -> list[dict]:
        if t is None:
            return []
        plain = plain_text(t)[0].translate(_ALIKE)
        return [
            {"start": m.start(), "end": m.end(), "canonical": canonical}
            for canonical, pattern in patterns for m in pattern.finditer(plain) if m.end() > m.start()
        ]

    return F.pandas_udf(lambda texts: texts.map(hits), "array<struct<start:int,end:int,canonical:string>>")(text)


@lru_cache(maxsize=NAMES_KEPT)
def name_words(name: str) -> Words:
    """The words of a name, which is met in many texts."""
    return Words(plain_text(name)[0])


def name_hits(words: Words, names: Sequence[dict]) -> list[tuple[int, int, str]]:
    return [
        (s, e, n["canonical"]) for n in names if not n["ending"]
        for s, e in words.find(name_words(n["name"]), n["fold"])
    ]


def named_clients(text: Column, names: Column) -> Column:
    """Clients one of whose names stands in the text; ``names`` holds the candidates."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        found = [
            [] if t is None or n is None else sorted({c for _, _, c in name_hits(Words(plain_text(t)[0]), n)}) for t, n in zip(texts, lists)
        ]
        return pd.Series(found, dtype="object")

    return F.pandas_udf(run, "array<string>")(text, names)


def _person_spans(plain: str, persons: Sequence[str]) -> Iterator[tuple[int, int]]:
    forms = [r"\s*".join(map(re.escape, re.findall(r"[^\s,]+|,", p))) for p in sorted(persons, key=len, reverse=True)]
    if forms:
        yield from (m.span() for m in re.finditer(rf"(?<!\w)(?:{'|'.join(forms)})(?!\w)", plain))


def mask(text: str, persons: Sequence[str], names: Sequence[dict], hits: Sequence[dict]) -> str:
    """The text with a mark for each find, in one pass from left to right. Overlapping finds become one mark."""
    plain, places = plain_text(text)
    words = Words(plain) if len(names) else None
    known = {" ".join(re.split(r"[\s-]+", n["name"])).lower() for n in names if not n["ending"]}
    persons = [p for p in persons if re.sub(r"[\s-]+", " ", p).lower() not in known]
    finds = [
        mail_spans(plain),
        phone_spans(plain),
        [*((h["start"], h["end"]) for h in hits), *((s, e) for s, e, _ in (name_hits(words, names) if words else ()))],
        _person_spans(plain, persons),
    ]
    merged: list[list[int]] = []
    for start, end, kind in sorted((s, e, k) for k, spans in enumerate(finds) for s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1:] = max(end, merged[-1][1]), min(kind, merged[-1][2])
        else:
            merged.append([start, end, kind])
    out, done = [], 0
    for start, end, kind in merged:
        out += text[done : places[start]], MARKS[KINDS[kind]]
        done = places[end - 1] + 1
    masked = "".join(out) + text[done:]
    endings = sorted({n["name"] for n in names if n["ending"]}, key=len, reverse=True)
    if endings:
        rest = rf"\b{MARKS['client']}\s*[{re.escape(HYPHENS)}]\s*(?:{'|'.join(map(re.escape, endings))})\b"
        masked = re.sub(rest, MARKS["client"], masked, flags=re.IGNORECASE)
    return masked


def replace_pii(text: Column, persons: Column, names: Column, hits: Column) -> Column:
    """Masked text; texts with nothing to find do not go to Python."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    seven_digits = text.rlike(r"(?U)(?:\d[^\p{L}\d]*+){7}")
    needed = text.contains("@") | seven_digits | some(persons) | some(names) | some(hits)

    def run(texts: pd.Series, *lists: pd.Series) -> pd.Series:
        filled = ([[] if x is None else x for x in c] for c in lists)
        return pd.Series([None if t is None else mask(t, *row) for t, *row in zip(texts, *filled)], dtype="object")

    return F.coalesce(F.pandas_udf(run, "string")(F.when(needed, text), persons, names, hits), text)


def span_count(text: Column, names: Sequence[dict], patterns: list[tuple[str, re.Pattern]]) -> Column:
    """Number of distinct places of one client's names and patterns."""

    def count(t: str | None) -> int:
        if not t:
            return 0
        words = Words(plain_text(t)[0])
        free = {m.span() for _, p in patterns for m in p.finditer(words.text)}
        return len(free | {(s, e) for s, e, _ in name_hits(words, names)})

    return F.pandas_udf(lambda texts: texts.map(count), "long")(text)
