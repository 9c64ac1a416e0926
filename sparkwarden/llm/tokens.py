"""Token ids of whole texts, by the tokenizers library, one Python worker at a time.

Natural text repeats its words, so a worker asks the library once per distinct
word and joins the stored ids: a text costs a lookup per word. That is exact because a text is only cut where the
library's own splitting has a border in any context:

* before a single space that is followed by a visible ASCII or Latin character, and
* before a newline between two visible characters.

Neither byte-level nor word-end BPE merges across such a border, white space runs
are never divided, and NFC or lower-casing does not look across it. Commas and full
stops behind a letter and before a blank are pieces of their own. A text that holds a
special token's string is encoded in one piece, since the library cuts such a text
elsewhere, and so is one that holds a null character, our sign for a mark cut off.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark provides the parallelism

from tokenizers import Tokenizer  # noqa: E402

CUT = re.compile(r" (?=[!-~À-ɏ])|(?<=[!-~À-ɏ])(?=\n[!-~À-ɏ])")
# A blank that may not be cut at; without one, splitting at all blanks gives the same.
KEPT = re.compile(r"[ \n](?![!-~À-ɏ])|(?<![!-~À-ɏ])\n")
# UTF-8 bytes of visible ASCII, of letters from À to ȿ, of blanks and newlines.
USUAL = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
LETTERS = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and (c.isascii() or c >= "À")]
MARKS = ".,;:!?*&$%#"
STOPS = (", ", ". ")  # after a letter they are cut off, so that fewer words differ
CUT_OFF = "\0"  # stands before a mark that was cut off
CACHE_ENTRIES = 800_000  # in two halves, the recently used words and those before
STORED = 100  # characters of the longest words that are stored
TEXT_BYTES = 4 << 20  # texts that are encoded at a time


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which no normal form changes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _simple(text: str) -> bool:
    """Whether every blank and newline may be cut at, told without a search by pattern."""
    try:
        if text.encode().translate(None, USUAL):
            return not KEPT.search(text)
    except UnicodeEncodeError:  # half a surrogate pair
        return not KEPT.search(text)
    odd = ("  ", " \n", "\n ", "\n\n")
    return not (text[0] == "\n" or text[-1] in " \n" or any(pair in text for pair in odd))


def _stops_apart(text: str) -> str:
    """Marks that are pieces of their own (see ``WordTable``) as words with a sign before."""
    for stop in STOPS:
        parts = text.split(stop)
        apart, last = f" {CUT_OFF}{stop}", parts.pop()
        if all([part[-1:].lower().isalpha() for part in parts]):
            text = apart.join([*parts, last])
        else:
            text = "".join([part + (apart if part[-1:].lower().isalpha() else stop) for part in parts]) + last
    return text


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class LetterWords:
    """Ids of words of Latin letters by the library's model alone.

    How the library spells a letter, and what it puts before a word behind nothing, a blank
    or a newline, is asked of its normaliser and pre-tokenizer once. ``pattern`` is None
    where such a word is not one piece whose letters are spelled alike in any place."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenize = tokenizer.model.tokenize
        self.pattern, self.spelling, self.leads, self.plain = None, {}, {}, False
        normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        if tokenizer.pre_tokenizer is None:
            return
        split = tokenizer.pre_tokenizer.pre_tokenize_str

        def pieces(text: str) -> list[str]:
            return [piece for piece, _ in split(normal(text))]

        bare = {c: pieces(c) for c in LETTERS}
        spelled = {c: p[0] for c, p in bare.items() if len(p) == 1}
        if not spelled:
            return
        letters = "".join(spelled)
        for probe in (letters, letters[::-1], "".join(c + c for c in letters)):
            word = "".join(map(spelled.get, probe))
            for lead in ("", " ", "\n"):
                *before, last = pieces(lead + probe)
                prefix = last.removesuffix(word)
                if prefix + word != last or self.leads.setdefault(lead, (before, prefix)) != (before, prefix):
                    return
        self.spelling = str.maketrans(spelled)
        self.leads = {
            lead: (b"".join(_packed([t.id for t in self.tokenize(piece)]) for piece in before), prefix)
            for lead, (before, prefix) in self.leads.items()
        }
        # Whether lower-case ASCII letters stand for themselves.
        self.plain = all(spelled.get(c) == c for c in map(chr, range(0x80)) if c.islower())
        self.pattern = re.compile(f"[{letters}]+")

    def encode(self, lead: str, word: str) -> bytes:
        """A word that ``pattern`` matches whole, behind ``lead``."""
        before, prefix = self.leads[lead]
        spelled = word if self.plain and word.isascii() and word.islower() else word.translate(self.spelling)
        return before + _packed([token.id for token in self.tokenize(prefix + spelled)])


class WordTable(dict):
    """Ids of the words behind ``lead`` (a blank, or nothing for the first word of a text),
    packed; a word that starts with a newline has no lead. New words are encoded when they
    are looked up."""

    def __init__(self, tokenizer: Tokenizer, letters: LetterWords, lead: str):
        super().__init__()
        self.tokenizer, self.letters, self.lead = tokenizer, letters, lead
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(word) <= STORED:
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        """Punctuation behind a letter (lower-cased: one that no mark follows) is a piece of
        its own in any context, so new marks behind a known word need no encoding of it."""
        if word[:1] == CUT_OFF:
            return _packed(self.tokenizer.encode(word[1:], add_special_tokens=False).ids)
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core[-1:].lower().isalpha():
            marks = word[len(core) :]
            if marks not in self.marks:
                ids = _packed(self.tokenizer.encode(marks, add_special_tokens=False).ids)
                if len(marks) > STORED:
                    return self[core] + ids
                self.marks[marks] = ids
            return self[core] + self.marks[marks]
        lead, letters = ("\n", word[1:]) if word[:1] == "\n" else (self.lead, word)
        if self.letters.pattern and self.letters.pattern.fullmatch(letters):
            return self.letters.encode(lead, letters)
        return _packed(self.tokenizer.encode(lead + letters, add_special_tokens=False).ids)

    def trim(self, entries: int) -> None:
        """Let go of the words not used lately where the table has half of ``entries``."""
        if 2 * len(self) > entries:
            self.older = dict(self)
            self.clear()
        if 2 * len(self.marks) > entries:
            self.marks.clear()


class WordCachedEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes,
    equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = (*(token.content for token in added), CUT_OFF)
        self.letters = LetterWords(self.tokenizer)
        self.first, self.others = (WordTable(self.tokenizer, self.letters, lead) for lead in ("", " "))
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)

    def _parts(self, text: str) -> list[str]:
        """The text cut into its first word and the others, those without their space."""
        if self.folds and (text.isascii() or _latin(text)):
            text = text.lower()  # as the library would, so that fewer words differ
        if _simple(text):
            return _stops_apart(text.replace("\n", " \n")).split(" ")
        return CUT.split(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        for table in (self.first, self.others):
            table.trim(CACHE_ENTRIES)
        return [self._one(text) if text else b"" for text in texts]

    def _one(self, text: str) -> bytes:
        if any(string in text for string in self.whole):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = iter(self._parts(text))
        return b"".join([self.first[next(words)], *map(self.others.__getitem__, words)])


@lru_cache(maxsize=4)
def encoder(path: str) -> WordCachedEncoder:
    """One encoder per tokenizer file and Python worker."""
    return WordCachedEncoder(path)
