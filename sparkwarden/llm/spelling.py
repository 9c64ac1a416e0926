"""Spelling variants: words one edit apart, found through sorted permuterm rotations.

Every word is closed by a terminator and written in all its rotations. With the last
character split off, a rotation is a prefix, its *gap*, and the character that stood in the
gap: words that differ by a replaced character have a rotation with the same gap, and a
word that lacks the character altogether has the gap itself as a whole rotation. So after
sorting, near words are neighbours in the prefix range of one gap. A gap names one word
and one place, therefore a range holds at most one whole rotation and one word per
character of the alphabet: ranges are bounded, and each word of a range emits one row, its
count of near words there and the best of them, not its pairs. Two words differing by a
replaced character share exactly one gap. A character inserted in a run of equal ones
could stand in several; only the first of the run counts (``lead``), so counts add up.

Words are maximal runs of A-Z, a-z and U+00C0-U+00FF of whole texts, A-Z lowered, damaged
as ``word_counts`` says, of at least six characters and five occurrences.

Given results: null and empty texts have no words; a null doc_id is written as nothing
before the colon; repeated rows count again; an empty table gives no rows; extra columns
are ignored. Ties between equally frequent near words go to the smaller in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded, release
from sparkwarden.shared import kept

END = "$"  # sorts apart from every letter
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
DAMAGE = 199
HELD = 200_000  # distinct words a task holds before it passes them on


def word_counts(docs: DataFrame, length: int = LEAST_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """(word, n): occurrences of each word of at least ``length`` characters. Where the
    CRC-32 h of ``<doc_id>:<word>`` is divisible by ``damage``, the word first loses its
    character h % its length. Counts combine in the task, again before the shuffle."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in bounded(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() lowers A-Z only
                for word, n in Counter(run.findall(text.lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()
        release()

    narrow = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary"))
    counted = narrow.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """One row per gap a word can stand in: ``whole`` where the gap is a full rotation,
    else ``lead`` tells whether the missing character starts a run of equal ones."""
    word = F.col("word")
    size = F.char_length(word)
    at = F.explode(F.sequence(F.lit(0), size)).alias("at")
    placed = words.select("word", "n", at)
    before, after = F.substring(word, F.lit(1), F.col("at")), F.col("at") + 1
    turned = F.concat(F.substring(word, after, size), F.lit(END), before)
    rest = F.concat(F.substring(word, after + 1, size), F.lit(END), before)
    letter, previous = F.substring(word, after, F.lit(1)), F.substring(word, F.col("at"), F.lit(1))
    lead = (F.col("at") == 0) | (letter != previous)
    whole = F.struct(turned.alias("gap"), F.lit(True).alias("whole"), F.lit(False).alias("lead"))
    part = F.struct(rest.alias("gap"), F.lit(False).alias("whole"), lead.alias("lead"))
    both = F.when(F.col("at") < size, F.array(whole, part)).otherwise(F.array(whole))
    return placed.select("word", "n", F.explode(both).alias("r")).select("r.gap", "word", "n", "r.whole", "r.lead")


def _range(members: list[tuple]) -> Iterator[tuple]:
    """(word, near words, best near word, its n) for the members of one gap, which come by
    falling n, then word."""
    whole = next((i for i, m in enumerate(members) if m[2]), None)
    parts = [i for i, m in enumerate(members) if not m[2]]
    leads = [i for i in parts if members[i][3]]
    for i, (word, _, is_whole, lead) in enumerate(members):
        if is_whole:
            near, best = len(leads), leads[0] if leads else None
        else:
            near = len(parts) - 1
            best = next((p for p in parts[:2] if p != i), None)
            if lead and whole is not None:
                near, best = near + 1, whole if best is None else min(best, whole)
        if near:
            yield word, near, members[best][0], members[best][1]


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _neighbours(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
    """What the ranges between ``starts`` emit; most hold a single word and emit nothing."""
    spans = [(a, b) for a, b in zip(starts[:-1], starts[1:]) if b - a > 1]
    taken = table.take([i for a, b in spans for i in range(a, b)]) if spans else table.slice(0, 0)
    members = list(zip(*(taken.column(c).to_pylist() for c in ("word", "n", "whole", "lead"))))
    out, at = [], 0
    for a, b in spans:
        out += _range(members[at : at + b - a])
        at += b - a
    columns = zip(*out) if out else ([] for _ in NEAR)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NEAR.types)], schema=NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, form, form_n) per word and gap range that holds near words of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last range may go on in the next batch
        for batch in bounded(batches, rows=50_000):
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            table = table.combine_chunks()
            gaps = table.column("gap").chunk(0)
            new = pc.not_equal(gaps[1:], gaps[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(new.nonzero()[0] + 1).tolist()]
            left = table.slice(starts[-1])
            yield _neighbours(table, starts)
        if left is not None:
            yield _neighbours(left, [0, left.num_rows])

    ordered = rotations(words).repartition("gap").sortWithinPartitions("gap", F.desc("n"), "word")
    return ordered.mapInArrow(scan, "word string, near long, form string, form_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a stored table (word, form): forms followed to the last. Every round
    doubles the steps taken; counts grow along a chain, so there are no circles and few
    rounds."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = F.col("next").isNotNull().alias("moved")
        stepped = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), moved)
        stepped = kept(stepped, "roots")
        reached = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return reached


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, form, n_near, form_n and root for ``words`` (word, n; each word once)."""
    words = kept(words, "words")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    near = near_words(words).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    taken = -F.col("best.less") >= factor * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.when(taken, F.col("best.form")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    known = kept(known, "forms")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``spelling_forms`` of the words that occur at least ``least`` times in ``docs``."""
    return spelling_forms(word_counts(docs).where(F.col("n") >= least))
