"""Packing, token counts and token files against the tokenizer libraries."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm.cases import DOCUMENTS, frame, rows_of
from sparkwarden.llm import packing, token_files
from sparkwarden.llm.token_counts import count_tokens, stored_counts, tokenizer_version
from sparkwarden.llm import tokens
from sparkwarden.llm.tokens import LETTERS, WordCachedEncoder, encoder
from sparkwarden.shared import new_folder

WORD, BYTE, PIECE = (
    public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")
)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoding_equals_the_library(path):
    library = Tokenizer.from_file(path)
    texts = [t for _, t in DOCUMENTS] + [
        "a  b", "a \n b", " a", "a ", "\n", "a\n\nb", "a\nb", "it's 'll x", "a | b || c|", "x́ y é",
        "1 22 333", "a b  c", "<|endoftext|> a <|startoftext|>b", "tab\tx \ty", "A. B, c!\nD\r\ne",
    ]
    got = encoder(path).encode(texts)
    for text, raw in zip(texts, got):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want, text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_letter_words_and_full_tables(path, monkeypatch):
    """Words of any Latin letters go to the model alone, and tables that overflow lose nothing."""
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    library, cached = Tokenizer.from_file(path), WordCachedEncoder(path)
    assert cached.letters.pattern
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(LETTERS, n)) for n in rng.integers(1, 12, 300)] + LETTERS
    for _ in range(20):
        texts = [join.join(rng.choice(words, 30)) + end for join in (" ", "\n", ", ", ".\n", "  ") for end in ("", " ", "\n", "!")]
        assert cached.encode(texts) == [
            np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts
        ]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_stops_nulls_and_long_words(path):
    """Marks are cut off behind letters only; a null character and long words change nothing."""
    library, cached = Tokenizer.from_file(path), WordCachedEncoder(path)
    long = "ab" * 5_000
    texts = [
        "a, b. c", "a , b .c", "3, b. c), d", "a., b,. c", "a,\nb.\nc, ", "., ", ", a", "İ, é. ß, x",
        "a \0, b", "a\0, b. c", "\0", f"{long}, {long}. {long}{'!' * 300} {long}{'!' * 300}", f"{long}",
    ]
    for _ in range(2):  # the second time from the tables
        assert cached.encode(texts) == [
            np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts
        ]
    assert max(map(len, [*cached.first, *cached.others])) <= tokens.STORED


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t\0|.,ab'É́ 9<>endoftext", max_size=40))
def test_cached_encoding_on_any_text(text):
    for path in (WORD, BYTE):
        want = encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist() == want


def test_packing_places_every_piece_once(spark):
    got = packing.packed_documents(frame(spark), WORD, capacity=256, group_pieces=8).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for doc_id, text in DOCUMENTS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((doc_id, piece, at, len(part), crc(part)))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert len(sequences) <= -(-sum(r.length for r in got) // 256) + 1


def test_packed_sequences_hold_the_ids(spark):
    items = packing.kept(packing.pieces(frame(spark), WORD, 128, 0, ids=True), "pieces")
    placed = packing.pack(items, 128)
    parts = {r["row"]: bytes(r["ids"]) for r in items.collect()}
    want = {}
    for r in sorted(placed.collect(), key=lambda r: r.offset):
        want[r.sequence_id] = want.get(r.sequence_id, b"") + parts[r["row"]]
    assert {r.sequence_id: bytes(r["ids"]) for r in packing.sequences(items, placed).collect()} == want


def test_bounds_and_best_fit():
    source = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(source.integers(8, 60))
        lengths = source.integers(1, capacity + 1, int(source.integers(1, 12)))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, capacity)
        assert fills.max() <= capacity and np.bincount(bins, weights=lengths).tolist() == fills.tolist()
        best = least_bins(sorted(lengths.tolist(), reverse=True), capacity)
        assert packing.lower_bound(*np.unique(lengths, return_counts=True), capacity) <= best <= len(fills)
    assert packing.lower_bound(np.array([6]), np.array([5]), 10) == 5  # the sum alone says 3


def least_bins(lengths, capacity, free=()):
    """Fewest bins by trying every place."""
    if not lengths:
        return len(free)
    head, *rest = lengths
    options = {f for f in free if f >= head}
    found = [least_bins(rest, capacity, tuple(sorted((*_without(free, f), f - head)))) for f in options]
    return min([*found, least_bins(rest, capacity, tuple(sorted((*free, capacity - head))))])


def _without(values, one):
    values = list(values)
    values.remove(one)
    return values


def test_counts_and_the_store(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    store = new_folder(spark, "store")
    want = []
    for doc_id, text in DOCUMENTS:
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert rows_of(count_tokens(frame(spark), PIECE, store, 100)) == sorted(want, key=repr)
    version = tokenizer_version(PIECE)
    assert stored_counts(spark, store, version).count() == len({t or "" for _, t in DOCUMENTS})
    # All digests are stored now: another run appends nothing, a new text one row.
    more = frame(spark, [*DOCUMENTS, (20, "a new text")])
    assert count_tokens(more, PIECE, store, 100).count() == len(DOCUMENTS) + 1
    assert stored_counts(spark, store, version).count() == len({t or "" for _, t in DOCUMENTS}) + 1
    assert stored_counts(spark, store, "other").count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    source = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 70_000, 2**32):
        ids = source.integers(0, top, 1003, dtype=np.uint64).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind) == ids).all()
    stream = io.BytesIO()
    writer = token_files.PlaneWriter(stream, kind, block_ids=64)
    docs = [source.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 63, 64, 65, 500, 0, 7)]
    for number, ids in enumerate(docs):
        writer.add(number if number else None, ids.tobytes())
    writer.close()
    stream.size = lambda: len(stream.getvalue())
    reader = token_files.PlaneReader(stream)
    for (doc_id, pieces), ids in zip(reader.documents(), docs, strict=True):
        assert b"".join(pieces) == ids.tobytes()
    assert all((reader.document(i) == ids).all() for i, ids in enumerate(docs))

    with pytest.raises(ValueError):
        broken = io.BytesIO(stream.getvalue()[:-3])
        broken.size = lambda: len(broken.getvalue())
        token_files.PlaneReader(broken)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_in_order(spark, kind):
    library = Tokenizer.from_file(BYTE)
    got = token_files.written_and_read(frame(spark), BYTE, 2, kind).collect()
    want = sorted(
        ((d, len(i), crc(i)) for d, i in ((d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in DOCUMENTS)),
        key=repr,
    )
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((d for d, _ in DOCUMENTS), key=lambda d: (d is not None, d))
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()


def test_empty_tables(spark):
    none = frame(spark).where("false")
    assert packing.packed_documents(none, WORD).count() == 0
    assert count_tokens(none, PIECE, new_folder(spark, "store"), 1).count() == 0
    assert token_files.written_and_read(none, BYTE, 2).count() == 0
