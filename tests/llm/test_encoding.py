"""Encoding, files, counts, spans and packing against the libraries and brute force."""

import hashlib
import unicodedata
import zlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from cadenza.llm import pieces, ranked_varint, sentencepiece_codec, slack_packing, token_count  # noqa: E402

ODD = [
    "", None, " ", "  a  b ", "word", " x", "x ", "x  ", "a <|endoftext|> b<|endoftext|>c", "héllo  wörld x   y", "ab́c İstanbul ΣΑΣ 日本 語 텍스트 🙂 x", "don't we'll I'M 1²3 ½ x\x00y \x01 \x00\x02\x01\x02\x00",
    "\n\n x\n y ", "▁ a ▁b c▁ d", "A" * 5000, "ſ ŉ Ÿ Ⱥ ǅ", "<|startoftext|> q", "\t a\tb \r\n c", "0 1 2 33 a1b2", "a\x85b \x1c c", "word " * 3000, "same", "same", "x" * 40 + " " + "x" * 40, "end.\nNext, line", "a|b <|x",
]


def library(kind, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    texts = [t or "" for t in texts]
    if kind == "piece":
        return SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(texts)
    return [e.ids for e in Tokenizer.from_file(P.path({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind])).encode_batch(texts, add_special_tokens=False)]


PATHS = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json", "piece": "piece_bpe_32k.model"}


@pytest.mark.parametrize("kind", list(PATHS))
def test_ids_equal_the_library(kind):
    enc = pieces.encoder(token_count.KINDS[kind], P.path(PATHS[kind]))
    flat, count = enc.encode(pa.array(ODD, pa.string()))
    at = np.append(0, np.cumsum(count))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [list(x) for x in library(kind, ODD)]
    assert (enc.count(pa.array(ODD, pa.string())) == count).all()
    assert len(enc.count(pa.array([], pa.string()))) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abE .,'’éßÀ0¹\n\t<|>▁~ 日́")), max_size=30), min_size=1, max_size=5))
def test_any_texts_equal_the_library(texts):
    for kind, path in PATHS.items():
        enc = pieces.encoder(token_count.KINDS[kind], P.path(path))
        flat, count = enc.encode(pa.array(texts, pa.string()))
        assert flat.tolist() == [i for x in library(kind, texts) for i in x], (kind, texts)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(ODD)], "doc_id long, text string, id int, part string")


def test_token_counts(docs):
    rows = {r.doc_id: r for r in token_count.token_counts(docs, P.path("byte_bpe_50k.json"), limit=4).collect()}
    for k, (t, ids) in enumerate(zip(ODD, library("byte", ODD), strict=True)):
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 4)
    assert token_count.token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_files_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    twice = docs.where("doc_id < 9").unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    ranked_varint.write_ids(twice, P.path("word_bpe_49k.json"), folder, file_bytes_limit=40)
    assert len(list((tmp_path / "ids").glob("*.rv"))) > 1
    rows = ranked_varint.read_ids(spark, folder).orderBy("start").collect()
    texts = [ODD[5], *ODD[:5], ODD[4], *ODD[5:9]]
    at = 0
    for r, i, ids in zip(rows, [None, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8], library("word", texts), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1
    ranked_varint.write_ids(docs.limit(0), P.path("word_bpe_49k.json"), f"file://{tmp_path}/none")
    assert not list((tmp_path / "none").glob("*.rv"))


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_values_round_trip(values):
    control, data = ranked_varint.pack_values(np.array(values, np.uint32))
    assert ranked_varint.unpack_values(control, data, len(values)).tolist() == values
    body = ranked_varint.file_bytes(np.array([7]), np.array([len(values)]), np.array(values, np.uint32), 5)
    ids, counts, ranks, before = ranked_varint.read_file(body)
    assert (ids.tolist(), counts.tolist(), ranks.tolist(), before) == ([7], [len(values)], values, 5)
    with pytest.raises(ValueError):
        ranked_varint.read_file(body + b"x")


def test_sentencepiece_codec(docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in sentencepiece_codec.codec(docs, P.path("piece_bpe_32k.model")).collect()}
    for k, t in enumerate(ODD):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert rows[k].aligned


def test_spans_cover_the_source(docs):
    for r in sentencepiece_codec.encode_spans(docs, P.path("piece_bpe_32k.model")).collect():
        source = (ODD[r.doc_id] or "").encode()
        assert len(r.ids) == len(r.begins) == len(r.ends)
        if source:
            assert r.begins[0] == 0 and r.ends[-1] == len(source)
            assert all(a == b for a, b in zip(r.ends, r.begins[1:], strict=False))


def trie(keys):
    """A double-array trie of {key: offset}, built naively: first fit for each node's children."""
    units, used, bases = [0] * 4096, {0}, set()

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        ends = prefix in keys
        base = next(b for b in range(1, 3000) if b not in bases and all((b ^ c) not in used for c in kids) and (not ends or b not in used))
        bases.add(base)
        used.update(base ^ c for c in kids)
        if ends:
            used.add(base)
            units[base] = keys[prefix] | 1 << 31
        units[node] |= (base ^ node) << 10 | (256 if ends else 0)
        for c in kids:
            units[base ^ c] = c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    return np.array(units, "<u4").tobytes()


def test_character_map_takes_the_longest_prefix():
    out = b"X\0YY\0\0"
    blob = trie({b"a": 0, b"ab": 2, "é".encode(): 5})
    m = sentencepiece_codec.CharacterMap(len(blob).to_bytes(4, "little") + blob + out)
    source, at, taken = "aabcéd".encode(), 0, []
    while at < len(source):
        taken.append((at, *m.prefix(source, at)))
        at += taken[-1][1]
    assert taken == [(0, 1, b"X"), (1, 2, b"YY"), (3, 1, b"c"), (4, 2, b""), (6, 1, b"d")]
    assert sentencepiece_codec.CharacterMap(b"").prefix("é".encode(), 0) == (2, "é".encode())


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_spans_of_a_model_with_a_character_map(tmp_path, spark, docs, drop, prefix):
    """The library's compiled NFKC map, with and without dropping of spaces; pieces must spell what the library makes of a text."""
    from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec, rules = pb.ModelProto(), pb.ModelProto()
    spec.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    rules.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.add_dummy_prefix = drop, prefix
    path = str(tmp_path / "mapped.model")
    open(path, "wb").write(spec.SerializeToString())
    library = SentencePieceProcessor(model_file=path)
    texts = ["ﬁne  ① Ａ b", "  two  spaces  ", "", None, "é e\u0301 ㍿ x\u3000y", "plain words", "tab\tand\nline", "½ № \u2581 mark", " ", *(t for t in ODD if t)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in sentencepiece_codec.encode_spans(df, path).collect()}
    digests = {r.doc_id: r for r in sentencepiece_codec.codec(df, path).collect()}
    for k, t in enumerate(texts):
        assert list(rows[k].ids) == library.encode(t or ""), t
        assert digests[k].aligned, t
        assert digests[k].spans_crc32 == zlib.crc32(np.stack([rows[k].begins, rows[k].ends], 1).astype("<u4").tobytes())
        source = (t or "").encode()
        assert all(0 <= x <= y <= len(source) for x, y in zip(rows[k].begins, rows[k].ends, strict=True))
        assert all(x <= y for x, y in zip(rows[k].ends, rows[k].begins[1:], strict=False)) or any(len(c.encode()) > 1 for c in t)
        pieces_ = [library.id_to_piece(i).replace("\u2581", " ") for i in rows[k].ids]
        for x, y, piece in zip(rows[k].begins, rows[k].ends, pieces_, strict=True):
            if piece.isascii() and len(piece.strip()) > 2 and not piece.startswith("<"):
                held = unicodedata.normalize("NFKC", source[x:y].decode(errors="ignore"))
                assert piece.strip() in held, (t, piece, held)
    assert (0, 3) in list(zip(rows[0].begins, rows[0].ends, strict=True)) or rows[0].ends[0] >= 3  # the ligature


def test_unknown_pieces_have_spans(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    for p in spec.pieces:
        if p.type == p.BYTE:
            p.type = p.UNUSED
    spec.trainer_spec.byte_fallback = False
    path = str(tmp_path / "unknown.model")
    open(path, "wb").write(spec.SerializeToString())
    a = sentencepiece_codec.Aligned(path)
    text = "word \U00010348 end"
    ids = np.array(a.library.encode(text), np.uint32)
    begins, ends, whole = a.spans(text, ids)
    assert whole and a.unknown[ids].any()
    k = int(np.flatnonzero(a.unknown[ids])[0])
    assert text.encode()[begins[k] : ends[k]].decode().strip() == "\U00010348"


def test_packing(spark, docs):
    model, cap = P.path("byte_bpe_50k.json"), 64
    rows = slack_packing.pack_documents(docs, model, cap).collect()
    for k, ids in enumerate(library("byte", ODD)):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        ids = [*ids, 0]
        assert [r.piece for r in own] == list(range(-(-len(ids) // cap)))
        assert all(r.length == cap for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [x for x, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= cap
    assert slack_packing.pack_documents(docs.limit(0), model, cap).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=8))
def test_plan_places_every_item_once(histogram):
    rows = slack_packing.plan(histogram, 30)
    load = {}
    for length, first, n, sequence, items, offset in rows:
        assert n % items == 0
        for k in range(n):
            load.setdefault(sequence + k // items, []).append((offset + k % items * length, length))
    for length, n in histogram.items():
        assert sorted((f, f + m) for a, f, m, *_ in rows if a == length)[-1][1] == n
    assert sum(map(len, load.values())) == sum(histogram.values())
    for b in load.values():
        b.sort()
        assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(n for _, n in b) <= 30


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 20))
def test_fullest_is_the_best_subset(counts, room):
    all_ = [0] * 21
    for n, c in counts.items():
        all_[n] = c
    best = {0}
    for n, c in counts.items():
        best = {b + k * n for b in best for k in range(c + 1)}
    taken = slack_packing.fullest(all_, sorted(counts, reverse=True), room)
    assert sum(n * k for n, k in taken.items()) == max(b for b in best if b <= room)
    assert all(k <= counts[n] for n, k in taken.items())
