"""Spelling variants of the vocabulary, by composing automata: vocabulary, one edit, vocabulary.

Words of the corpus are counted; those frequent enough are the vocabulary. Two are near if one inserted, deleted or replaced code point
turns one into the other. Such pairs are the accepted pairs of A o E o A, with A the minimised acceptor of the vocabulary and E
the transducer of exactly one edit:

- Before the edit both copies of A read the same characters. A is deterministic, so the composed state is (p, p).
- The edit leads from (p, p) to (p after a, p after b), (p after a, p) or (p, p after b).
- Behind it both copies read the same again, so the rest is any string in the intersection of two right languages. As A is
  minimised these repeat, and each intersection is worked out once.

The whole composition would have one initial state and be one task's work. It is cut by the state in which a pair begins: words
that share their first half are the strings behind one state of the prefix tree, and these, with that state as initial state,
are a partition with an acceptor of its own. Let m be the length of the shorter word and h = m // 2. If the edit is not within the first
h characters, both words have those in common and meet in that partition. Otherwise they have the last m - h characters in common and meet in
the partition of the reversed words. A word enters for m its own length and one less, so four times. A pair is reported
where its edit lies only: forward if h characters or more are common, backward otherwise.

Roots are found by pointer doubling: a form is at least five times as frequent as its word, so the rounds end after
the logarithm of the logarithm of the largest count.

Defined results: null and empty texts have no words. Null identifiers count as the empty string in the hash that decides deletions.
Repeated rows count as often as they are there. A word without near words has no form, null ``form_n`` and itself as root. A table without
words gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import blocks
from ampertrace.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: one in so many (document, word) pairs has a character deleted
ODD_ONE = 199
#: how many times as frequent a form is
FORM = 5
#: characters that an acceptor reads at most, but for one
WINDOW = 200
#: words that a task counts before it hands them on
HELD = 200_000


def count_words(slim: DataFrame) -> DataFrame:
    """``word n`` of the columns ``_id _t``; tasks add up before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])

        for rows, texts in blocks(batches, "_t"):
            for (id_,), text in zip(rows, texts):
                own: dict[str, int] = {}
                for w in RUN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")):
                    if len(w) >= LEAST_LENGTH:
                        own[w] = own.get(w, 0) + 1
                start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % ODD_ONE == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < LEAST_LENGTH:
                            continue
                    held[w] = held.get(w, 0) + n
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimised acceptor of sorted words: ``arcs[state]`` by character, ``final`` states. Equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        # the path of the last word: its states' arcs are open until the next word leaves them
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path.extend(({}, False) for _ in word[same:])
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])
        self.common: dict[tuple[int, int], tuple[str, ...]] = {}

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *sorted(arcs.items()))
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def rests(self, p: int, q: int) -> tuple[str, ...]:
        """Strings that lead from both states to final ones."""
        if p > q:
            p, q = q, p
        found = self.common.get((p, q))
        if found is None:
            out = [""] if self.final[p] and self.final[q] else []
            few, many = (self.arcs[p], self.arcs[q]) if len(self.arcs[p]) <= len(self.arcs[q]) else (self.arcs[q], self.arcs[p])
            for c, r in few.items():
                if c in many:
                    out += [c + rest for rest in self.rests(r, many[c])]
            found = self.common[(p, q)] = tuple(out)
        return found

    def edit_pairs(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted strings one edit apart, each in one order and as often as there are places for the edit."""
        todo = [(self.start, "")]
        while todo:
            p, read = todo.pop()
            arcs = list(self.arcs[p].items())
            for i, (a, r) in enumerate(arcs):
                todo.append((r, read + a))
                for b, s in arcs[i + 1 :]:
                    for rest in self.rests(r, s):
                        yield read + a + rest, read + b + rest
                for rest in self.rests(r, p):
                    yield read + a + rest, read + rest


def edit_pairs(words: list[str], shorter: int) -> Iterator[tuple[str, str]]:
    """Near pairs whose shorter word has ``shorter`` characters, in some order, perhaps repeated.

    Long words are looked at through windows of ``WINDOW`` characters, one of which holds the edit: words that agree before and behind it
    have an acceptor of what lies within.
    """
    for start in range(0, max(1, shorter), WINDOW):
        behind = max(0, shorter - start - WINDOW)
        groups: dict[tuple[int, int], dict[str, str]] = {}
        for w in words:
            end = len(w) - behind
            groups.setdefault((hash(w[:start]), hash(w[end:])), {})[w[start:end]] = w
        for inner in groups.values():
            if len(inner) > 1:
                for a, b in Acceptor(sorted(inner)).edit_pairs():
                    if min(len(inner[a]), len(inner[b])) == shorter:
                        yield inner[a], inner[b]


def partition_pairs(counts: dict[str, int], shorter: int, backward: bool) -> Iterator[tuple[str, str]]:
    """Near pairs of one partition's words (reversed ones if ``backward``) whose shorter word has ``shorter`` characters."""
    head = shorter // 2
    cut = shorter - head if backward else head
    shared = next(iter(counts))[:cut]
    seen = set()
    for a, b in edit_pairs([w[cut:] for w in counts], shorter - cut):
        a, b = shared + a, shared + b
        # a pair with the first half in common is found forward
        if backward and a[::-1][:head] == b[::-1][:head]:
            continue
        pair = (a, b) if a < b else (b, a)
        if pair not in seen:
            seen.add(pair)
            yield (pair[0][::-1], pair[1][::-1]) if backward else pair


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``a na b nb`` of each two near words, once, of a vocabulary ``word n``."""
    length = F.length("word")
    placed = vocabulary.withColumn("m", F.explode(F.array(length, length - 1))).filter("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    sides = placed.select(
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("backward"), F.substring("word", F.lit(1), half).alias("part"), F.col("word").alias("w")),
                F.struct(F.lit(True).alias("backward"), F.reverse(F.substring("word", half + 1 + length - F.col("m"), length)).alias("part"), F.reverse("word").alias("w")),
            )
        ).alias("s"), "m", "n"
    ).select("s.*", "m", "n")

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, counts = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(counts) < 2:
                return
            turned = {w[::-1]: n for w, n in counts.items()} if key[0] else counts
            rows = [(a, turned[a], b, turned[b]) for a, b in partition_pairs(counts, key[1], key[0])]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["a", "na", "b", "nb"])

        for batch in batches:
            for backward, m, part, w, n in zip(*(batch.column(c).to_pylist() for c in ("backward", "m", "part", "w", "n"))):
                if (backward, m, part) != key:
                    yield from found()
                    key, counts = (backward, m, part), {}
                counts[w] = n
        yield from found()

    keys = ("backward", "m", "part")
    return sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a string, na bigint, b string, nb bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word root`` of words with a ``form``: the last word reached by following forms."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # a word that ends its chain is no key of this table, so the first round without a further step is the last
        now = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if now.filter("_moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``word form root n n_near form_n`` of each word of the vocabulary."""
    counted = count_words(docs.select(column(docs, id_).cast("string").alias("_id"), column(docs, text).alias("_t")))
    vocabulary = cut_lineage(counted.filter(F.col("n") >= LEAST_COUNT))
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("nb").alias("form_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("na").alias("form_n")),
    )))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("form_n").alias("most"), F.min_by("form", F.struct(-F.col("form_n"), F.col("form"))).alias("form"))
    joined = vocabulary.join(best, "word", "left")
    is_form = F.col("most") >= FORM * F.col("n")
    table = cut_lineage(joined.select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("most")).alias("form_n")
    ))
    ends = roots(table.filter("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
