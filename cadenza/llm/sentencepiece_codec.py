"""SentencePiece encoding with the source bytes of every piece, and decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pieces import PieceBPE, encoder


class CharacterMap:
    """The compiled character map of a SentencePiece model: a double-array trie over UTF-8 keys, and zero-ended replacements.

    An empty map changes nothing.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.out = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that source has at this place."""
        if not self.units:
            return None
        # A unit holds: bits 0-7 its label (bit 31 as well, set in value units), bit 8 "has a value", bits 10-30 the offset,
        # which is shifted by 8 more where bit 9 is set.
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = offset(self.units[0]), None
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[k]:
                break
            node ^= offset(unit)
            if unit & 256:
                begin = self.units[node] & 0x7FFFFFFF
                best = k + 1 - at, self.out[begin : self.out.index(b"\0", begin)]
        return best

    def prefix(self, source: bytes, at: int) -> tuple[int, bytes]:
        """How many source bytes are taken at this place and what stands for them: the longest key, else one character."""
        found = self.longest(source, at)
        if found:
            return found
        length = 1 if source[at] < 0x80 else 2 if source[at] < 0xE0 else 3 if source[at] < 0xF0 else 4
        return length, source[at : at + length]


class Aligned:
    """A model's encoding with spans: for every id the bytes [begin, end) of the source text that it came from."""

    MARK = "\u2581".encode()

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.map, self.norm = CharacterMap(spec.normalizer_spec.precompiled_charsmap), spec.normalizer_spec
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.library = SentencePieceProcessor(model_file=path)
        self.user = sorted((p.piece.encode() for p in spec.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        #: Normalised bytes that each id stands for, with a space for the mark; None for unknown ids.
        byte = lambda p: bytes([int(p.piece[3:5], 16)])
        self.bytes = [byte(p) if p.type == p.BYTE else None if p.type == p.UNKNOWN else b"" if p.type == p.CONTROL else p.piece.encode().replace(self.MARK, b" ") for p in spec.pieces]
        self.width = np.array([len(x) if x is not None else 0 for x in self.bytes])
        self.unknown = np.array([x is None for x in self.bytes])
        try:
            self.fast = encoder(PieceBPE, path)
        except ValueError:  # its pieces can cross spaces, so whole texts go to the library
            self.fast = None
        self.identical = not self.map.units and not self.user and not self.norm.remove_extra_whitespaces and not self.suffix

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (no begin and end ids), and how many each text has."""
        if self.fast:
            return self.fast.encode(column)
        found = [self.library.encode(t or "") for t in column.to_pylist()]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())), count

    def normalize(self, source: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text as the model sees it, with a space for the mark, and for each of its bytes where the source bytes begin and
        end that it stands for."""
        drop = self.norm.remove_extra_whitespaces
        lead = self.norm.add_dummy_prefix and not self.suffix
        if self.identical and self.MARK not in source:
            at = np.arange(len(source) + 1)
            return (b" " + source, np.append(0, at[:-1]), at) if lead and source else (source, at[:-1], at[1:])
        out, begins, ends, at = bytearray(), [], [], 0

        def taken() -> tuple[int, bytes]:
            own = next((u for u in self.user if source.startswith(u, at)), None)
            length, to = (len(own), own) if own else self.map.prefix(source, at)
            return length, to.replace(self.MARK, b" ")

        while drop and at < len(source):
            length, to = taken()
            if to != b" ":
                break
            at += length
        if at < len(source) and lead:
            out, begins, ends = bytearray(b" "), [at], [at]
        after_space = drop
        while at < len(source):
            length, to = taken()
            while after_space and to.startswith(b" "):
                to = to[1:]
            if to:
                out += to
                same = to == source[at : at + length]  # then its bytes stay apart
                begins += range(at, at + length) if same else [at] * len(to)
                ends += range(at + 1, at + length + 1) if same else [at + length] * len(to)
                after_space = drop and to.endswith(b" ")
            at += length
        while drop and out.endswith(b" "):
            del out[-1], begins[-1], ends[-1]
        if self.norm.add_dummy_prefix and self.suffix and out:
            out += b" "
            begins.append(ends[-1])
            ends.append(ends[-1])
        return bytes(out), np.array(begins, np.int64), np.array(ends, np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """(begins, ends, whole) of an encoding without begin and end ids: all source bytes that a part of each id comes from,
        in order; whole says whether the pieces spell the normalised text. The dummy space has no bytes."""
        body, begins, ends = self.normalize(text.encode())
        width, parts = self.width[ids], [self.bytes[i] for i in ids.tolist()]
        if self.unknown[ids].any():  # only the library knows what an unknown id stands for
            parts = [p if p is not None else s.encode().replace(self.MARK, b" ") for p, s in zip(parts, self.library.encode(text, out_type=str), strict=True)]
            width = np.fromiter(map(len, parts), np.int64, len(parts))
        if b"".join(parts) != body:  # no model whose pieces spell its text comes here
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), False
        to = np.cumsum(width)
        if not len(body):
            return to, to, True
        begin = begins[np.minimum(to - width, len(body) - 1)]
        return begin, np.where(width > 0, ends[np.maximum(to, 1) - 1], begin), True


_ALIGNED: dict[str, Aligned] = {}


def _aligned(model: str) -> Aligned:
    """One instance for each worker process."""
    if model not in _ALIGNED:
        _ALIGNED[model] = Aligned(model)
    return _ALIGNED[model]


def _encoded(a: Aligned, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(ids, begins, ends, whole) of each text; a null is an empty text."""
    flat, count = a.ids(column)
    at = np.append(0, np.cumsum(count)).tolist()
    for x, y, text in zip(at, at[1:], column, strict=False):
        yield flat[x:y], *a.spans(text.as_py() or "", flat[x:y])


def encode_spans(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int> (no begin or end id), begins and ends array<int> (source bytes of each piece).

    Null and empty texts have empty arrays; texts of any length are encoded whole; unknown pieces span the characters that the
    model lacks. Repeated rows and null ids stay; other columns aren't read, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ints = _aligned(model), pa.list_(pa.int32())
        for b in batches:
            rows = list(_encoded(a, b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k].astype(np.int32) for r in rows], ints) for k in range(3))], names=["id", "ids", "begins", "ends"])

    common.ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("id", id_col)


def codec(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (with begin and end ids, decoded by the library), spans_crc32 (of all
    pieces' source bytes, begin and end as little-endian 32-bit integers in turn), aligned (the pieces spell the whole text).

    Every text goes through the same encoder as in encode_spans. Null texts count as empty (begin and end id only, decoded to
    nothing, aligned). Repeated rows and null ids stay; other columns aren't read, whatever their names; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _aligned(model)
        first, last = np.array([a.library.bos_id()], "<u4"), np.array([a.library.eos_id()], "<u4")
        for b in batches:
            count, sha, decoded, crc, aligned = [], [], [], [], []
            for found, begins, ends, whole in _encoded(a, b.column(1)):
                ids = np.concatenate([first, found.astype("<u4"), last])
                count.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(a.library.decode(ids.tolist()).encode()).hexdigest())
                crc.append(zlib.crc32(np.stack([begins, ends], 1).astype("<u4").tobytes()))
                aligned.append(whole)
            columns = [pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string()), pa.array(crc, pa.int64()), pa.array(aligned, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "aligned"])

    common.ship(docs.sparkSession)
    thin = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return thin.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, aligned boolean").withColumnRenamed("id", id_col)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through piece_bpe_32k.model and back."""
    import public_tokenizers

    common.bounded_batches(spark)
    return codec(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
