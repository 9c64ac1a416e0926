"""Benchmark decontamination by an FM-index per training shard.

Every task cuts its documents into shards of bounded size, indexes each shard and
searches all benchmark phrases in it. Nothing is shuffled and no text leaves its task.
A phrase is ``window`` consecutive words of an item, or a whole shorter item. Words
that no phrase has cannot take part in an occurrence, so a shard's index holds only
runs of phrase words that are at least as long as the shortest phrase.

The benchmark does not grow with the corpus, but it is not trusted to be small: items
are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass each, and
what the passes find is joined by document. One block is the usual case.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.

Given results: null, empty or wordless documents have no words and no hits. Items with
null text count as wordless and never occur. Items with a null id hit words and are cut
like any other, but are not counted or named. Item ids are compared as strings; items with
one text all count. Repeated documents each get their row; equal doc_ids stay apart by
row. Empty tables give no rows, or rows without hits. Extra columns are ignored, except
that ``decontaminated`` carries the documents' own columns through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.phrase_index import PhraseIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 18

# A-Z become a-z; every other ASCII character but digits and letters becomes a space.
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


class Phrases:
    """The distinct phrases of a block of items and the items that have each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item_id, text in items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item_id)
        self.numbers = numbers
        self.lengths = np.array([len(p) for p in owners], dtype=np.int64)
        self.table = np.zeros((len(owners), window), dtype=np.int64)
        for row, phrase in enumerate(owners):
            self.table[row, : len(phrase)] = phrase
        self.owners = [sorted(o - {None}) for o in owners.values()]
        self.shortest = int(self.lengths.min()) if owners else 0


def runs_of(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of known words (positive ids) that are long enough."""
    known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
    change = np.diff(known)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long_enough = ends - starts >= shortest
    return starts[long_enough], ends[long_enough]


class Shard:
    """Runs of several whole documents, waiting to be indexed."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if not len(starts):
            return
        sizes = ends - starts + 1  # each run with the unknown word, or the end, behind it
        places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        self.parts.append(np.append(ids, 0)[places])
        self.docs.append(np.full(len(places), doc, dtype=np.int64))
        self.places.append(places)
        self.size += len(places)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word position, phrase) of every occurrence."""
        if not self.parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        index = PhraseIndex(np.concatenate(self.parts), len(phrases.numbers) + 1)
        low, high = index.ranges(phrases.table, phrases.lengths)
        phrase, position = index.locate(low, high)
        return np.concatenate(self.docs)[position], np.concatenate(self.places)[position], phrase


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, touching ones joined."""
    out: list[list[int]] = []
    order = np.lexsort((ends, starts))
    for start, end in zip(starts[order].tolist(), ends[order].tolist()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _found(texts: list[bytes | None], phrases: Phrases) -> Iterator[tuple[int, list, set[str]]]:
    """(words, merged word spans, item ids) per text, shard by shard."""
    get = phrases.numbers.get
    counts, shard, begun = [], Shard(), 0

    def close() -> Iterator[tuple[int, list, set[str]]]:
        docs, places, phrase = shard.search(phrases)
        order = np.argsort(docs, kind="stable")
        docs, places, phrase = docs[order], places[order], phrase[order]
        cuts = np.searchsorted(docs, np.arange(begun, len(counts) + 1))
        for number, a, b in zip(counts[begun:], cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                yield number, [], set()
                continue
            spans = merged(places[a:b], places[a:b] + phrases.lengths[phrase[a:b]])
            yield number, spans, {i for p in np.unique(phrase[a:b]).tolist() for i in phrases.owners[p]}

    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        if phrases.shortest and len(words) >= phrases.shortest:
            ids = np.array([get(w, 0) for w in words], dtype=np.int64)
            shard.add(len(counts) - 1, ids, *runs_of(ids, phrases.shortest))
        if shard.size >= SHARD_WORDS:
            yield from close()
            shard, begun = Shard(), len(counts)
    yield from close()


def benchmark_blocks(
    benchmark: DataFrame, size: int = BLOCK_BYTES
) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Items in blocks of bounded text; the driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    block, total, any_block = [], 0, False
    for row in rows.toLocalIterator():
        block.append((row["item_id"], bytes(row["text"]) if row["text"] is not None else None))
        total += len(row["text"] or b"")
        if total >= size:
            yield block
            block, total, any_block = [], 0, True
    if block or not any_block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _fresh(taken: list[str], *names: str) -> list[str]:
    """The names with underscores added until none of them is taken."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def _fields(frame: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields if f.name in names)


def _pass(
    frame: DataFrame, block: list, window: int, keep: list[str], own: list[str], cut: bool = False
) -> DataFrame:
    """One block searched in ``frame.text``; ``own`` names the result columns, whose
    earlier contents (from other blocks) are merged in. With ``cut`` the spans are cut
    out of the text instead of being told."""
    sent = frame.sparkSession.sparkContext.broadcast(Phrases(block, window))  # bounded by BLOCK_BYTES
    words, spans, items = own
    again = spans in frame.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in bounded(batches):
            found = list(_found(batch.column("text").cast(pa.binary()).to_pylist(), phrases))
            hits = [f[1] for f in found]
            owners = [f[2] for f in found]
            if again:
                for i, (old, ids) in enumerate(
                    zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist())
                ):
                    pairs = [(x["start"], x["end"]) for x in old] + hits[i]
                    hits[i] = merged(*np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
                    owners[i] |= set(ids)
            if cut:
                yield _without_spans(batch, keep, hits)
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep]
                + [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in h] for h in hits], _SPANS),
                    pa.array([sorted(o) for o in owners], pa.list_(pa.string())),
                ],
                [*keep, *own],
            )

    result = f"`{words}` long, `{spans}` array<struct<start:long,end:long>>, `{items}` array<string>"
    return frame.mapInArrow(find, _fields(frame, keep)[:-2] if cut else _fields(frame, keep) + result)


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    own: tuple[str, str, str] = ("n_words", "spans", "items"),
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    cut: bool = False,
) -> DataFrame:
    """``keep`` columns of ``docs`` with, under the names ``own``, the number of words,
    the merged word spans that benchmark phrases cover, and the ids of those items; with
    ``cut`` the ``keep`` columns alone, without the words of the spans in the text."""
    frame = docs.withColumn("text", F.col("text").cast("string"))
    blocks = benchmark_blocks(benchmark, block_bytes)
    block = next(blocks)
    for later in blocks:
        frame = _pass(frame, block, window, docs.columns, list(own))
        block = later
    return _pass(frame, block, window, keep, list(own), cut)


def contamination(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return search(narrow, benchmark, ["doc_id"], **sizes).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches from the first to the last word of each span."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_LOWER))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _without_spans(batch: pa.RecordBatch, names: list[str], hits: list[list]) -> pa.RecordBatch:
    changed = {i: None for i, hit in enumerate(hits) if hit}
    if changed:
        texts = batch.column("text").to_pylist()
        changed = {i: _cut(texts[i], hits[i]) for i in changed}
    arrays = []
    for name in names:
        column = batch.column(name)
        if changed and name in ("text", "n_chars"):
            values = column.to_pylist()
            for i, text in changed.items():
                values[i] = text if name == "text" else len(text)
            column = pa.array(values, column.type)
        arrays.append(column)
    return pa.RecordBatch.from_arrays(arrays, names)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """``docs`` with every benchmark span cut out of its text and n_chars, where there is
    such a column, set to the new length. Clean rows come back as they were."""
    own = _fresh(docs.columns, "n_words", "spans", "items")
    return search(docs, benchmark, docs.columns, own=tuple(own), cut=True, **sizes)
