"""Exact batch encoding in which every distinct piece of a batch meets the tokenizer once.

A batch's texts lie in one byte buffer. It is cut before single spaces at which the tokenizer can't see across, the pieces
are numbered by their bytes (exactly: equal numbers are checked to mean equal bytes), the distinct ones are encoded by the
library, and ids are laid out again in document order. Cutting is exact for any Unicode text: a place that isn't known to be
safe is no cut, and a text without safe places is one piece.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes after the end of a buffer, so that loads of 32 bytes stay inside it.
PAD = 40
#: Pieces up to this many bytes are compared as whole machine words; longer ones are encoded one by one.
WORDS = 4
#: Bytes of text that one pass handles; a longer text is a pass of its own, cut into pieces like any other.
PASS_BYTES = 3 << 19

#: Of a piece's k-th machine word, the bits that belong to the piece, by the piece's length.
_MASKS = [np.array([2 ** (8 * min(8, max(0, n - 8 * k))) - 1 for n in range(8 * WORDS + 1)], np.uint64) for k in range(WORDS)]
_ASCII = np.zeros(256, bool)
_ASCII[33:127] = True
#: Lead bytes of U+00C0 to U+02FF: two-byte characters, none of them white space or combining.
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xCC] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Signs before which a word ends. Not the bar: it stands inside special tokens.
_SIGN = _ASCII & ~_LETTER
_SIGN[[*range(48, 58), ord("|")]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with padding, and where each begins (and the last ends). Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([body, np.zeros(PAD, np.uint8)]), at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Ranges of documents with about as many bytes each."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def cuts(buf: np.ndarray, offsets: np.ndarray, runs: bool = False) -> np.ndarray:
    """Where pieces begin: at each non-empty text's start and before safe spaces.

    runs=False: a space or newline between two characters that are no white space, the place after that newline, and
    the sign after a letter. runs=True: the first of a run of spaces, unless U+2581 stands before it (that sign means a
    space to SentencePiece).
    """
    n = int(offsets[-1])
    space = np.flatnonzero(buf[:n] == 32 if runs else (buf[:n] == 32) | (buf[:n] == 10))
    space = space[(space > 1) & (space < n)]
    ends = np.zeros(n + 2, bool)
    ends[offsets] = True
    before = buf[space - 1]
    if runs:
        ok = (before != 32) & ~((before == 0x81) & (buf[space - 2] == 0x96)) & ~ends[space + 1]
    else:
        after = buf[space + 1]
        ok = (_ASCII[before] | ((before >= 0x80) & _LATIN[buf[space - 2]])) & (_ASCII[after] | _LATIN[after]) & ~ends[space + 1]
    begins = np.zeros(n + 1, bool)
    begins[space[ok]] = True
    if not runs and n:
        begins[1:n] |= _LETTER[buf[: n - 1]] & _SIGN[buf[1:n]]
        begins[space[ok & (buf[space] == 10)] + 1] = True
    begins[offsets[:-1]] = True
    begins[n] = False
    return np.flatnonzero(begins)


def numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers, from 0 in the order of their first places."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its number, and for each number the index of its first piece.

    Equal numbers always mean equal bytes. With long=True equal bytes mean equal numbers as well; else each piece beyond
    8 * WORDS bytes has a number of its own.
    """
    n = len(starts)
    length = ends - starts
    short = length <= 8 * WORDS
    load = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
    words = []
    mixed = length.astype(np.uint64)
    bounded = np.minimum(length, 8 * WORDS)
    for k in range(WORDS):
        word = load[np.minimum(starts + 8 * k, len(load) - 1)] & _MASKS[k][bounded]
        words.append(word)
        mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    codes = np.empty(n, np.int64)
    found = numbered(mixed[short])
    codes[short] = found
    top = int(found.max()) + 1 if len(found) else 0
    rest = np.arange(n - len(found))
    if long and len(rest):
        seen: dict[bytes, int] = {}
        rest = np.array([seen.setdefault(buf[a:b].tobytes(), len(seen)) for a, b in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)])
    codes[~short] = top + rest
    first = np.empty(int(codes.max()) + 1 if n else 0, np.int64)
    first[codes[::-1]] = np.arange(n)[::-1]
    same = first[codes]
    if any(((w[same] != w) & short).any() for w in words) or (length[same] != length)[short].any():
        # Two different pieces met in 64 bits: tell all of this batch apart by their bytes.
        seen = {}
        codes = np.array([seen.setdefault(buf[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.empty(len(seen), np.int64)
        first[codes[::-1]] = np.arange(n)[::-1]
    return codes, first


def spread(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[begin[0]:begin[0]+count[0]], values[begin[1]:...], ... in one array."""
    total = int(count.sum())
    shift = begin - (np.cumsum(count) - count)
    return values[np.repeat(shift, count) + np.arange(total)]


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 signs stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Library:
    """The tokenizers library on a file, loaded when a text first needs it."""

    def __get__(self, enc, kind):
        from tokenizers import Tokenizer

        enc.__dict__["library"] = Tokenizer.from_file(enc.path)
        return enc.__dict__["library"]


class _Encoder:
    """encode(texts): ids of all texts one after another, and how many each has."""

    runs = False
    dtype = np.uint32

    def pieces(self, parts: list[bytes], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. inner: the piece isn't the first of its text."""
        raise NotImplementedError

    def prepared(self, buf: np.ndarray) -> np.ndarray:
        return buf

    def _pass(self, buf: np.ndarray, offsets: np.ndarray):
        """Ids of the distinct pieces with their bounds, each piece's number, and how many pieces each document has."""
        buf = self.prepared(buf)
        starts = cuts(buf, offsets, self.runs)
        ends = np.append(starts[1:], offsets[-1])
        codes, first = distinct(buf, starts, ends)
        raw = buf.tobytes()
        parts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        inner = np.ones(len(starts), bool)
        inner[np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])] = False
        if self.runs:  # a first piece has another meaning than the same bytes later on
            twice = np.unique(codes[~inner])
            if len(twice) and np.isin(codes[inner], twice).any():
                codes = codes * 2 + inner
                kinds, codes = np.unique(codes, return_inverse=True)
                parts, marks = [parts[k >> 1] for k in kinds.tolist()], (kinds & 1).astype(bool)
            else:
                marks = inner[first]
        else:
            marks = inner[first]
        ids, count = self.pieces(parts, marks) if parts else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        per_doc = np.diff(np.searchsorted(starts, offsets))
        return ids, count, codes, per_doc

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        buf, offsets = text_bytes(column)
        out, counts = [], []
        for a, b in passes(offsets):
            at = offsets[a : b + 1] - offsets[a]
            ids, count, codes, per_doc = self._pass(np.append(buf[offsets[a] : offsets[b]], np.zeros(PAD, np.uint8)), at)
            of_piece = count[codes]
            out.append(spread(ids, (np.cumsum(count) - count)[codes], of_piece))
            counts.append(_sums(of_piece, per_doc))
        return np.concatenate([np.zeros(0, self.dtype), *out]), np.concatenate([np.zeros(0, np.int64), *counts])

    def count(self, column) -> np.ndarray:
        """How many ids each text has; the ids themselves aren't laid out."""
        buf, offsets = text_bytes(column)
        counts = []
        for a, b in passes(offsets):
            at = offsets[a : b + 1] - offsets[a]
            _, count, codes, per_doc = self._pass(np.append(buf[offsets[a] : offsets[b]], np.zeros(PAD, np.uint8)), at)
            counts.append(_sums(count[codes], per_doc))
        return np.concatenate([np.zeros(0, np.int64), *counts])


def _sums(values: np.ndarray, per_group: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    at = np.append(0, np.cumsum(per_group))
    return total[at[1:]] - total[at[:-1]]


def _split(ids: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(ids == mark)
    return ids[ids != mark], np.diff(np.append(np.append(-1, at), len(ids))) - 1


class ByteBPE(_Encoder):
    """A byte-level BPE file of the tokenizers library, with the plain byte-level pattern and no normalizer.

    Its merges run in tiktoken, which gives the same ids faster; texts that hold the inner separator go to the library itself.
    """

    library = _Library()
    #: Fixed value: the byte-level pattern of the vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SEP = "\x00\x02\x01\x02\x00"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or spec["normalizer"] or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"][m] <= model["vocab"][k] for k, m in zip(joined, joined[1:], strict=False)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.path = path
        self.mark = max(max(ranks.values()), *special.values()) + 1
        self.core = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special | {self.SEP: self.mark})

    def pieces(self, parts, inner):
        text = self.SEP.encode().join(parts).decode()
        if text.count(self.SEP) != len(parts) - 1 or "\x00\x02" in text.replace(self.SEP, ""):
            found = [x.ids for x in self.library.encode_batch([p.decode() for p in parts], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found])
        return _split(self.core.encode_to_numpy(text, allowed_special="all"), self.mark)


class WordBPE(_Encoder):
    """A BPE file of the tokenizers library with word ends, lower case and white space dropped.

    Words of Latin letters run in tiktoken with a sign for the word's end that merges first; pieces with other characters go
    to the library itself.
    """

    library = _Library()
    #: The letters, numbers and white space up to U+017F.
    LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
    ODD = re.compile("[^\x02-ſ]|İ|<\\|")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special, suffix = {t["content"] for t in spec["added_tokens"]}, spec["model"]["end_of_word_suffix"]
        byte = _byte_of()
        raw = lambda k: bytes(byte[c] for c in k)
        ranks, self.ids = {}, np.zeros(len(vocab) + 600, np.uint32)
        ended = [k for k in vocab if k.endswith(suffix) and len(k) == len(suffix) + 1 and raw(k[0]) != b"\0"]
        order = [*((raw(k[0]) + b"\0", vocab[k]) for k in ended)]
        for m in merges:
            k = "".join(m.split(" ") if isinstance(m, str) else m)
            order.append((raw(k.removesuffix(suffix)) + b"\0" * k.endswith(suffix), vocab[k]))
        order += [(raw(k), i) for k, i in vocab.items() if len(k) == 1 and k not in special]
        for rank, (k, i) in enumerate(order):
            if k in ranks:
                raise ValueError(f"{path}: two tokens have the same bytes")
            ranks[k], self.ids[rank] = rank, i
        self.path = path
        self.mark = len(ranks)
        self.core = tiktoken.Encoding("own", pat_str="[^\x00\x01]+\x00", mergeable_ranks=ranks, special_tokens={"\x01": self.mark})
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[{self.NUMBERS}]|[^{self.SPACES}{self.LETTERS}{self.NUMBERS}\x01]+")

    def prepared(self, buf):
        return buf if ((buf[:-1] == 60) & (buf[1:] == 124)).any() else _LOWER[buf]

    def pieces(self, parts, inner):
        plain, odd = [], {}
        strange = self.ODD.search(b" ".join(parts).decode())
        for k, p in enumerate(parts):
            word = p[1:] if p[:1] == b" " else p
            if word.isalpha():  # for bytes, this is of ASCII alone
                plain.append(word.lower() + b"\0")
                continue
            text = word.decode()
            if strange and self.ODD.search(text):
                odd[k] = text
                plain.append(b"")
            elif text.isalpha():
                plain.append(text.lower().encode() + b"\0")
            else:
                plain.append("".join([w + "\0" for w in self.word.findall(text.lower())]).encode())
        ids, count = _split(self.core.encode_to_numpy(b"\x01".join(plain).decode(), allowed_special="all"), self.mark)
        ids = self.ids[ids]
        if odd:
            at, found = np.array([*odd]), [x.ids for x in self.library.encode_batch([*odd.values()], add_special_tokens=False)]
            begin = np.cumsum(count) - count
            ids = np.insert(ids, np.repeat(begin[at], [len(x) for x in found]), [i for x in found for i in x])
            count[at] = [len(x) for x in found]
        return ids, count


class PieceBPE(_Encoder):
    """A SentencePiece BPE model without a character map, and with a dummy prefix; begin and end ids are left to the caller."""

    runs = True

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.cuttable = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        self.cuttable &= not any("\u2581" in p.piece.lstrip("\u2581") or p.type == p.USER_DEFINED for p in spec.pieces)
        if not self.cuttable:
            raise ValueError(f"{path}: its pieces can cross spaces")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def pieces(self, parts, inner):
        texts = [p[1:].decode() if k else p.decode() for p, k in zip(parts, inner.tolist(), strict=True)]
        found = self.library.encode(texts, num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())), count


_LOADED: dict = {}


def encoder(kind: type[_Encoder], path: str) -> _Encoder:
    """One instance for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
