"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds a header (MAGIC, then documents, ids, control bytes, data bytes and the number of ids in all files before it,
as little-endian 64-bit integers), the documents' ids (64 bits) and lengths (32 bits), the control bytes (four 2-bit byte
lengths each) and the data bytes. File names ascend with doc_id. ``ranks.bin`` holds the token id of each rank.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import WordBPE, encoder

MAGIC = b"RANKVAR1"
#: Data bytes after which a new file begins.
FILE_BYTES = 32 << 20
#: The lengths of the four values of a control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_VALUE = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    codes = np.append(more, np.zeros(-len(v) % 4, np.uint8)).reshape(-1, 4)
    return (codes << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by one look-up of each control byte's lengths and one load for each value."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    body = data + b"\0\0\0\0"
    load = np.ndarray(len(body) - 3, "<u4", body, 0, (1,))
    return load[np.cumsum(length) - length] & _VALUE[length]


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    control, data = pack_values(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data), before], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_file(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Documents' ids, their lengths, all ranks, and the number of ids before this file."""
    if body[:8] != MAGIC:
        raise ValueError("not a file of ranked ids")
    docs, n, control, data, before = np.frombuffer(body, "<i8", 5, 8).tolist()
    at = 48 + 12 * docs
    if len(body) != at + control + data:
        raise ValueError("the file is cut off")
    ranks = unpack_values(body[at : at + control], body[at + control :], n)
    return np.frombuffer(body, "<i8", docs, 48), np.frombuffer(body, "<u4", docs, 48 + 8 * docs), ranks, before


def put(path: str, body: bytes) -> None:
    """Writes under another name first, so that a lost or repeated task leaves whole files only."""
    fs, where = pafs.FileSystem.from_uri(path)
    context = TaskContext.get()
    draft = f"{where}.{context.taskAttemptId() if context else 0}.{time.time_ns()}"
    with fs.open_output_stream(draft) as f:
        f.write(body)
    fs.move(draft, where)


def write_ids(docs: DataFrame, model: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_bytes_limit: int = FILE_BYTES) -> None:
    """Encodes all texts (null: empty) with the end id after each, and writes the files in ascending order of ids.

    Each text is encoded once: ids are staged in the order of doc_id while their frequencies are counted, then written by
    rank. Equal ids stay separate documents, side by side; null ids come first, as the lowest number. An empty table gives
    ranks.bin alone.
    """
    spark = docs.sparkSession
    staged = common.Staged(spark, "ranked-ids")
    parts = common.partitions(spark)
    lowest = -(2**63)
    thin = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(lowest)).alias("id"), docs[text_col].alias("text"))
    cut = thin.agg(F.percentile_approx("id", [(k + 1) / parts for k in range(parts - 1)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(sorted(set(cut or [])), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordBPE, model)
        for b in batches:
            flat, count = enc.encode(b.column(1))
            ids = np.insert(flat, np.cumsum(count), end_id)
            kind = "<u2" if not len(ids) or ids.max() < 65536 else "<u4"
            raw, n = memoryview(ids.astype(kind).tobytes()), (count + 1) * int(kind[2])
            at = np.append(0, np.cumsum(n)).tolist()
            part = np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array(count + 1, pa.int64()), pa.array([raw[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["part", "id", "n", "ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before + np.cumsum(n) - n)], names=["part", "id", "n", "ids", "before"])
            before += int(n.sum())

    dealt = thin.mapInArrow(encode, "part int, id long, n long, ids binary").repartitionById(max(1, parts), "part").sortWithinPartitions("id", "ids")
    rows = staged.write(dealt.mapInArrow(numbered, "part int, id long, n long, ids binary, before long"), "encoded")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for i, n in zip(b.column("ids"), b.column("n").to_pylist(), strict=True):
                body = i.as_buffer()
                seen = np.bincount(np.frombuffer(body, f"<u{len(body) // n}"), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    # At most one row for each token of the vocabulary.
    seen = rows.select("n", "ids").mapInArrow(histogram, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    order = np.array([t for t, _ in sorted(((r["token"], r["n"]) for r in seen), key=lambda x: (-x[1], x[0]))], np.uint32)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))
    totals = dict(rows.groupBy("part").agg(F.sum("n")).collect())  # a row for each partition
    base, running = {}, 0
    for part in sorted(totals):
        base[part], running = running, running + totals[part]
    common.make_dir(spark, folder)
    put(f"{folder}/ranks.bin", order.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            part, _, before, _ = held[0]
            ids, counts = np.array([h[1] for h in held], np.int64), np.array([len(h[3]) for h in held])
            put(f"{folder}/ids-{part:08d}-{before:016d}.rv", file_bytes(ids, counts, np.concatenate([h[3] for h in held]), base[part] + before))
            done = [part], [len(held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.int64())], names=["part", "docs"])

        size = 0
        for b in batches:
            for part, i, n, before, body in zip(*(b.column(c).to_pylist() for c in ("part", "id", "n", "before")), b.column("ids"), strict=True):
                if held and (held[0][0] != part or size >= file_bytes_limit):
                    yield flush()
                    size = 0
                raw = body.as_buffer()
                held.append((part, i, before, rank[np.frombuffer(raw, f"<u{len(raw) // n}")]))
                size += 2 * n
        if held:
            yield flush()

    rows.mapInArrow(write, "part int, docs long").agg(F.sum("docs")).collect()
    staged.drop(rows)


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens, ids_crc32 (of the token ids as little-endian 32-bit integers)."""
    fs, where = pafs.FileSystem.from_uri(f"{folder}/ranks.bin")
    with fs.open_input_stream(where) as f:
        order = np.frombuffer(f.read(), "<u4")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                ids, counts, ranks, before = read_file(body.as_buffer().to_pybytes())
                raw = memoryview(order[ranks].tobytes())
                at = np.append(0, np.cumsum(counts, dtype=np.int64))
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids).cast(pa.int64()), pa.array(before + at[:-1]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rv").load(folder).select("content")
    out = files.mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("id", F.when(F.col("id") > -(2**63), F.col("id"))).withColumnRenamed("id", id_col)


def op4_ranked_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents under word_bpe_49k.json, written to files and read back."""
    import public_tokenizers

    common.bounded_batches(spark)
    staged = common.Staged(spark, "ranked-varint")
    folder = staged.path("files")
    write_ids(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return staged.keep(read_ids(spark, folder))
