"""Best-fit packing with certified repacking.

Documents are cut into pieces of at most ``capacity`` tokens. Each partition of pieces is packed by best-fit decreasing
and given a lower bound on its number of bins, the largest over a family of dual-feasible functions: a function f with
the property that sizes which fit into a bin have values f that sum to one at most, so the values of all pieces, summed
and rounded up, bound the bins from below. A partition whose bins meet its bound is certified and done. In the others
the pieces of all bins that are not full, and of every ``MIXED``-th bin for choice, are exchanged: they are dealt anew
over fewer partitions and packed again, until nothing is left to exchange, an exchange saves no bin, or the pieces have met in one
partition. As bounds are rounded up once per partition, the loosely filled bins of certified partitions take part in the exchange.
The certificates are part of the result: bins and bound of each partition that was packed, and of all pieces together.

A partition holds ``partition_pieces`` pieces on average, so a task's memory does not grow with the corpus; pieces are
dealt by a hash of a running number, so no source, group of copies or repeated row gathers in one.

Defined results: a null or empty text is one piece, its end token alone. Repeated rows are packed each for itself. A table
without rows gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.bpe import Encoder, encoded_rows
from ampertrace.llm.codes import arrow_type, blocks
from ampertrace.session import cut_lineage

CAPACITY = 4096
END = 1
PARTITION_PIECES = 20_000
#: of the bins of a partition with a gap, the share that is exchanged even if full
MIXED = 8
#: rounds that a sequence's number has room for
MOST_ROUNDS = 2047
#: bins filled up to this share of the capacity are exchanged by certified partitions too
LOOSE = 0.75


def cut_pieces(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id piece start length ids_crc32`` of each piece of each document."""
    tables = encoded_rows(docs.sparkSession, path)
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for rows, texts in blocks(batches, "_t"):
            out = []
            for (doc,), ids in zip(rows, encoder.encode(texts)):
                ids = np.append(ids, END).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, piece, start, len(part), zlib.crc32(part)))
            kinds = (id_arrow, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each size: the fullest bin that still has room, largest sizes first. Also the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    # open bins by the room they have left; bit r of ``rooms`` tells that some bin has room r
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, made
            made += 1
        bins[i] = chosen
        if room > size:
            open_bins[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, made


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions.

    For a threshold t up to half the capacity: sizes over capacity - t count as a whole bin, sizes under t as nothing,
    others as they are. For k = 1, 2, ...: a size x counts x / capacity where (k + 1) x is a multiple of the
    capacity, else floor((k + 1) x / capacity) / k.
    """
    return bound_of(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The bound of so many pieces of each size from 0 to the capacity."""
    if not counts.any():
        return 0
    size = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * size, capacity)
        # in units of 1 / (k * capacity)
        value = np.where(rest == 0, size * k, whole * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Bin, offset and filling of the bin for each size; the number of bins and its bound."""
    bins, made = best_fit_decreasing(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    before = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
    offsets = np.empty(len(sizes), dtype=np.int64)
    offsets[order] = ends - sizes[order] - before
    filled = np.bincount(bins, weights=sizes, minlength=made).astype(np.int64)
    return bins, offsets, filled[bins], made, lower_bound(sizes, capacity)


@dataclass
class Packing:
    """``placed``: the pieces with ``sequence_id`` and ``offset``. ``certificates``: ``round partition bins bound`` of each partition as it was
    packed. ``bins`` are used in all, and any packing of the pieces needs ``bound``."""

    placed: DataFrame
    certificates: DataFrame
    rounds: int
    bins: int
    bound: int


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> Packing:
    """Pack pieces (column ``length``, and what else they carry).

    ``pieces`` should be a written table: it is read for the histogram of its lengths and to be packed.
    """
    columns = pieces.columns
    place = "_group long, _bin long, offset bigint, _filled bigint, _made bigint, _bound bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "_key bigint, _round int", place])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, filled, made, bound = pack_group(frame["length"].to_numpy(), capacity)
        return frame.assign(_bin=bins, offset=offsets, _filled=filled, _made=made, _bound=bound)

    # at most ``capacity`` lengths
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n = sum(lengths.values())
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[list(lengths)] = list(lengths.values())
    pool = pieces.withColumn("_key", F.monotonically_increasing_id()).withColumn("_round", F.lit(0))
    done: list[DataFrame] = []
    packed_rounds: list[DataFrame] = []
    groups, number, before = max(1, -(-n // partition_pieces)), 0, None
    bin_of = F.struct("_group", "_bin")
    while True:
        # another seed in each round deals the pieces of a partition over all others
        dealt = pool.withColumn("_group", F.pmod(F.xxhash64("_key", F.lit(number)), F.lit(groups)))
        packed = cut_lineage(dealt.groupBy("_group").applyInPandas(run, schema).withColumn("_round", F.lit(number)))
        packed_rounds.append(packed)
        gap = (F.col("_made") > F.col("_bound")) & ((F.col("_filled") < capacity) | (F.col("_bin") % MIXED == number % MIXED))
        exchanged = gap | (F.col("_filled") <= int(LOOSE * capacity))
        found = packed.filter(exchanged).agg(F.count("*").alias("n"), F.count_distinct(bin_of).alias("bins")).first()
        used = packed.select(bin_of).distinct().count()
        # bins that this round made of the pieces it was given; the round before had ``before``
        if not found["n"] or groups == 1 or (before is not None and used >= before) or number == MOST_ROUNDS:
            done.append(packed)
            break
        before = found["bins"]
        done.append(packed.filter(~exchanged))
        pool = packed.filter(exchanged).select(*columns, "_key", "_round")
        groups, number = max(1, min(groups - 1, -(-found["n"] // partition_pieces))), number + 1
    placed = reduce(DataFrame.unionByName, done)
    sequence = F.shiftleft(F.col("_round").cast("long"), 52).bitwiseOR(F.shiftleft(F.col("_group"), 26)).bitwiseOR(F.col("_bin"))
    certificates = reduce(DataFrame.unionByName, packed_rounds).groupBy(F.col("_round").alias("round"), F.col("_group").alias("partition")).agg(
        F.max("_made").alias("bins"), F.max("_bound").alias("bound")
    )
    bins = sum(d.select(bin_of).distinct().count() for d in done)
    return Packing(
        placed.select(*[F.col(f"`{c}`") for c in columns], sequence.alias("sequence_id"), "offset"), certificates, len(done), bins, bound_of(counts, capacity)
    )


def pack_documents(
    docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES
) -> DataFrame:
    """``doc_id piece start length ids_crc32 sequence_id offset`` of every piece."""
    pieces = cut_lineage(cut_pieces(docs, path, id_, text, capacity))
    return pack(pieces, capacity, partition_pieces).placed
