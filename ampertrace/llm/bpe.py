"""BPE encoding and decoding in batched numpy merge rounds.

A task cuts its texts into words and numbers the distinct ones; each is encoded once. The symbols of all these words lie in one flat array. A round looks each neighbouring pair up by binary search in
the sorted pair keys, takes the lowest rank of each word and merges that pair wherever it occurs in the word, left to
right. Words without a pair leave the array. One round merges all occurrences of a pair at once, which gives what
merging one by one gives, as a pair with a new symbol always ranks behind the pair that made it (``Tables`` checks this).

The vocabulary is read on the driver and broadcast: its size is fixed by the tokenizer, not by the data.

Defined results: a null text is an empty one and has no ids. Special tokens written out in a text are that token.
Repeated rows are encoded alike. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import MOST_CODES, Codes, arrow_type, blocks, ranges

NO_RANK = np.iinfo(np.int32).max
WORD_END = "</w>"
#: symbols of words that are merged at once
MERGE_SYMBOLS = 1 << 15


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


@dataclass
class Tables:
    """Numbers of a BPE vocabulary with word ends, as arrays."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    inner: np.ndarray
    last: np.ndarray
    tokens: list[str]
    specials: dict[str, int]
    pattern: str
    width: int

    @classmethod
    def read(cls, path: str) -> Tables:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        width = max([*vocab.values(), *specials.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(left * width + right, kind="stable")
        tokens = [""] * width
        for token, number in [*vocab.items(), *specials.items()]:
            tokens[number] = token
        rank = np.arange(len(pairs))
        born = np.full(width, -1)
        np.maximum.at(born, made, rank)
        if len(pairs) and ((rank <= born[left]) | (rank <= born[right])).any():
            raise ValueError("a pair ranks before the pair that makes its symbol; merging in rounds would differ")
        letters = byte_letters()
        kind = np.uint32 if width**2 < 1 << 32 else np.int64
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(
            keys=(left * width + right)[order].astype(kind), ranks=rank[order].astype(np.int32), made=made[order].astype(kind), tokens=tokens, specials=specials, pattern=pattern, width=width,
            inner=np.array([vocab[c] for c in letters], dtype=kind), last=np.array([vocab[c + WORD_END] for c in letters], dtype=kind),
        )


def lookup(t: Tables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and product of each pair."""
    key = left * t.keys.dtype.type(t.width) + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    hit = t.keys[at] == key
    return np.where(hit, t.ranks[at], np.int32(NO_RANK)), t.made[at]


def merge_words(t: Tables, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other, and the number of ids of each. Words are not empty."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = t.inner[raw]
    ends = np.cumsum(sizes) - 1
    symbols[ends] = t.last[raw[ends]]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [], []
    rank, made = np.full(len(symbols), NO_RANK, dtype=np.int32), np.zeros_like(symbols)
    fresh = np.flatnonzero(word[:-1] == word[1:])
    while len(symbols):
        rank[fresh], made[fresh] = lookup(t, symbols[fresh], symbols[fresh + 1])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[starts, len(word)])
        best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        over = best == NO_RANK
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            keep = ~over
            symbols, word, rank, made, best = symbols[keep], word[keep], rank[keep], made[keep], best[keep]
            if not len(symbols):
                break
        merge = rank == best
        # of neighbouring places of one pair (a a a) every second one merges
        places = np.arange(len(merge))
        first = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], places, 0))
        merge &= (places - first) % 2 == 0
        symbols[merge] = made[merge]
        gone = np.r_[False, merge[:-1]]
        changed = merge | np.r_[merge[1:], False] | np.r_[merge[2:], False, False][: len(merge)]
        keep = ~gone
        symbols, word, changed = symbols[keep], word[keep], changed[keep]
        rank, made = rank[keep], made[keep]
        inside = np.r_[word[:-1] == word[1:], False]
        rank[changed & ~inside] = NO_RANK
        fresh = np.flatnonzero(changed & inside)
    if not done_symbols:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.int64), np.bincount(word, minlength=len(words))


@dataclass
class Encoder:
    """Encodes texts; remembers the words it has met, up to a bound."""

    tables: Tables
    words: Codes = field(default_factory=Codes)

    def __post_init__(self):
        t = self.tables
        self._special = re.compile("(" + "|".join(map(re.escape, t.specials)) + ")") if t.specials else None
        # texts within Latin-1 need no normal form, and Python's lower case agrees; the classes are written out for them
        latin = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}")}
        plain = t.pattern
        for k, letters in latin.items():
            plain = plain.replace(k, letters)
        self._plain_word = re.compile(plain).findall
        self._plain = re.compile(r"[\t-\r\x20-\x7e\x85\xa0-\xac\xae-\xff]*").fullmatch
        self._space = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self._cut = pre_tokenizers.Split(Regex(t.pattern), "removed", invert=True)
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self._ids, self._size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._start = self._size

    def _pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if "<|" in text and self._special is not None and self._special.search(text):
            parts = [p for p in self._special.split(text) if p]
            return [w for p in parts for w in ([p] if p in self.tables.specials else self._pieces(p))]
        if self._plain(text):
            return self._plain_word(text.lower())
        found: list[str] = []
        for chunk in self._space.split(text):
            if self._plain(chunk):
                found += self._plain_word(chunk.lower())
            else:
                found += [w for w, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(chunk))]
        return found

    def _learn(self, known: int) -> None:
        """Encode the words from number ``known`` on."""
        specials = self.tables.specials
        ids, counts, part, held = [self._ids], [self._size], [], 0

        def flush() -> None:
            if part:
                a, b = merge_words(self.tables, part)
                ids.append(a)
                counts.append(b)
                part.clear()

        for w in islice(self.words, known, None):
            if w in specials:
                flush()
                ids.append(np.array([specials[w]]))
                counts.append(np.array([1]))
                held = 0
                continue
            part.append(w.encode("utf-8", "surrogatepass"))
            held += len(part[-1])
            if held >= MERGE_SYMBOLS:
                flush()
                held = 0
        flush()
        self._ids, self._size = np.concatenate(ids), np.concatenate(counts)
        self._start = np.cumsum(self._size) - self._size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MOST_CODES:
            self._forget()
        known = len(self.words)
        pieces: list[str] = []
        counts = []
        for t in texts:
            pieces += self._pieces(t)
            counts.append(len(pieces))
        codes = np.fromiter(map(self.words.__getitem__, pieces), dtype=np.int32, count=len(pieces))
        if len(self.words) > known:
            self._learn(known)
        # one gather for the block, cut at the documents' ends
        sizes = self._size[codes]
        flat = self._ids[ranges(self._start[codes], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][counts]
        return np.split(flat, ends[:-1])


def decode(tables: Tables, ids: np.ndarray) -> str:
    """Tokens joined by spaces, as a tokenizer without decoder does; special tokens stay."""
    return " ".join(map(tables.tokens.__getitem__, ids.tolist()))


def encoded_rows(spark: SparkSession, path: str):
    """The broadcast tables of a tokenizer file."""
    return spark.sparkContext.broadcast(Tables.read(path))


def token_digests(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the text decoded from them."""
    tables = encoded_rows(docs.sparkSession, path)
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    id_type, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")

    def run(batches):
        encoder = Encoder(tables.value)
        for rows, texts in blocks(batches, "_t"):
            out = []
            for (doc,), ids in zip(rows, encoder.encode(texts)):
                decoded = decode(encoder.tables, ids).encode("utf-8", "surrogatepass")
                out.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), (id_arrow, pa.int64(), pa.string(), pa.string()))], names=names)

    return slim.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id ids``: the ids of each document."""
    tables = encoded_rows(docs.sparkSession, path)
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    id_arrow = arrow_type(slim, "doc_id")

    def run(batches):
        encoder = Encoder(tables.value)
        for rows, texts in blocks(batches, "_t"):
            ids = [i.tolist() for i in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=id_arrow), pa.array(ids, type=pa.list_(pa.int64()))], names=("doc_id", "ids"))

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<bigint>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id text`` from ``doc_id ids``; null ids give a null text."""
    tables = encoded_rows(encoded.sparkSession, path)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [None if i is None else decode(tables.value, np.array(i, dtype=np.int64)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=("doc_id", "text"))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<bigint>")).mapInArrow(run, f"doc_id {kind}, text string")
