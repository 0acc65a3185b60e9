"""Plain Python counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rule_counts(text: str | None) -> dict:
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "base_failed": len(w) < 50 or 100 * len(repeated) > 50 * len(w),
    }


SECRETS = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


def secret_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    found = []
    for number, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), number, kind, m.end()))
    return sorted(found)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def shingles(text: str | None) -> set:
    w = words(ascii_lower(text or ""))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    met = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for g in s for j in met[g])
        for g in s:
            met[g].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def clean_lines(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str | None]]:
    places = defaultdict(list)
    for i, t in sorted(docs, key=lambda d: d[0]):
        kept = [x for x in (t or "").split("\n") if words(x)]
        for k in range(len(kept) - 2):
            places[tuple(kept[k : k + 3])].append((i, k))
    covered = defaultdict(set)
    for found in places.values():
        for i, k in sorted(found)[1:]:
            covered[i] |= {k, k + 1, k + 2}
    out = {}
    for i, t in docs:
        number, kept = -1, []
        for x in (t or "").split("\n"):
            number += bool(words(x))
            if not (words(x) and number in covered[i]):
                kept.append(x)
        out[i] = (number + 1, len(covered[i]), None if t is None else "\n".join(kept))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text: str | None) -> tuple[int, list[int], str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), starts, ",".join(sorted(labels))
