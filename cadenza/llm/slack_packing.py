"""Packing token sequences by minimum bin slack: each bin takes the fullest feasible combination of the lengths still there."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import ByteBPE, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, model: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each document's ids with its end id into pieces of capacity; only the first piece of a document may be shorter.

    A document that fits is one piece. Null and empty texts are the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteBPE, model)
        for b in batches:
            flat, count = enc.encode(b.column(1))
            at = np.cumsum(count)
            ids = np.insert(flat.astype("<u4"), at, end_id)
            raw, n = memoryview(ids.tobytes()), count + 1
            pieces = -(-n // capacity)
            begin = np.repeat(np.cumsum(n) - n, pieces)
            k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = np.repeat(n - (pieces - 1) * capacity, pieces)
            start = np.where(k == 0, 0, head + (k - 1) * capacity)
            length = np.where(k == 0, head, capacity)
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((begin + start).tolist(), (begin + start + length).tolist(), strict=True)]
            ids_of = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), pieces)))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    common.ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)


def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """Of lengths (descending) with so many items each, how many to take of which so that they fill room as far as possible."""
    reach, steps = [1], []
    everything = (1 << (room + 1)) - 1
    for length in lengths:
        left, chunk = min(counts[length], room // length) if length <= room else 0, 1
        while left:
            take = min(chunk, left)
            reach.append((reach[-1] | reach[-1] << (take * length)) & everything)
            steps.append((length, take))
            left, chunk = left - take, 2 * chunk
        if reach[-1] >> room:
            break
    total, taken = reach[-1].bit_length() - 1, {}
    for (length, take), before in zip(reversed(steps), reversed(reach[:-1]), strict=True):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= take * length
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, items a sequence, offset): where the items of a length go by rank.

    A bin starts with the longest item left and takes the fullest combination beside it; the same combination is used as
    often as its items last. So the work and the table depend on the number of different lengths, not on that of items.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    lengths = sorted((n for n in histogram if histogram[n]), reverse=True)
    rank, sequence, rows = [0] * (capacity + 1), 0, []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        taken = fullest(counts, lengths, capacity - seed)
        counts[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        offset = 0
        for n, k in sorted(taken.items(), reverse=True):
            rows.append((n, rank[n], times * k, sequence, k, offset))
            rank[n] += times * k
            counts[n] -= times * k
            offset += n * k
        sequence += times
        lengths = [n for n in lengths if counts[n]]
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length ..., each at most capacity long).

    Every piece is in one sequence, sequences are gapless from offset 0, and no sequence is longer than capacity. The
    histogram of lengths (at most capacity rows) is all that reaches the driver. Empty input gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # One sortable number for (length, rank): ranks stay below 2^50.
    keys = (rows[:, 0] << np.int64(50)) + rows[:, 1]
    table = spark.sparkContext.broadcast((keys, rows))  # at most a few rows for each of capacity lengths

    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << np.int64(50)) + rank, "right") - 1
            _, first, _, sequence, items, offset = rows[at].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-2]], pa.array(sequence + k // items), pa.array(offset + k % items * length)], names=names)

    ranked = common.gapless(pieces, ["length"], ["doc_id", "piece"], "_rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, model: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces() and pack() over whole documents; the pieces are computed once and staged.

    A null text is an empty one: the end id alone, one piece. Repeated rows are packed once each; texts of any length are packed
    whole; an empty table gives no rows; other columns aren't read, whatever their names.
    """
    staged = common.Staged(docs.sparkSession, "packing")
    return staged.keep(pack(staged.write(token_pieces(docs, model, capacity, end_id, id_col, text_col), "pieces"), capacity))


def op6_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens of byte_bpe_50k.json."""
    import public_tokenizers

    common.bounded_batches(spark)
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
