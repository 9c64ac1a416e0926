"""Documents and rows with every awkward case, shared by the operator tests."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()


def sentence(seed: int, words: int) -> str:
    source = random.Random(seed)
    return " ".join(source.choice(WORDS) + source.choice("abcdefghij") for _ in range(words))


LONG = sentence(99, 30_000)
DOCUMENTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "One."),
    (5, sentence(1, 40)),
    (6, sentence(1, 40)),  # an exact copy
    (7, sentence(1, 40).upper() + "  "),
    (8, sentence(2, 300) + " tail"),
    (9, sentence(2, 300) + " other"),
    (10, LONG),
    (11, "Ünïcode 😀 größer als\x00 nul | bar <|endoftext|> x  y\n\nz w"),
    (11, "Ünïcode 😀 größer als\x00 nul | bar <|endoftext|> x  y\n\nz w"),  # a repeated row
    (None, sentence(3, 50)),
    (12, sentence(4, 3000)),
    (-5, sentence(1, 40)),
]


def frame(spark, rows=DOCUMENTS):
    """doc_id and text with columns whose names the operators use themselves."""
    extra = [(*row, "en", "src0", len(row[1] or ""), 7, "x") for row in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, start int, spans string"
    )


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
