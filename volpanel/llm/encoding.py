"""Ids of texts by a public vocabulary file; what occurs often is kept.

Texts of plain characters are split into words together, some ``TOGETHER`` bytes at a time: borders come from the classes of their bytes, every different word is
looked up once, and one that isn't kept goes to the merges of the vocabulary alone. The store has two generations:
when the younger one is full it becomes the older one, whose entries come back as they are met. The vocabulary's word pattern never reaches over
white space, and neither composing characters nor lower-casing does, so in any other text the stretches between white space are encoded one by one,
those with characters whose class or case may differ by the tokenizer as it is. ``tests/llm`` compares with the tokenizer on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GENERATION = 200_000  # entries of one generation of the store
LONGEST_KEPT = 48
TOGETHER = 1 << 21  # bytes of texts whose words are looked up at once; a longer text is alone
#: Characters at which Python splits and the tokenizer doesn't, and the beginning of its markers of special ids.
OTHERWISE = re.compile("[\x1c-\x1f]|<\\|")
#: Characters that mean the same to the word pattern below and to the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ž]*")
#: The word pattern of the vocabulary file, and the same for the characters above.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: Classes of the bytes of plain lower-case texts; all characters of several bytes are letters.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[list(b"\t\n\r ")] = SPACE
CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = LETTER
CLASS[list(b"0123456789")] = DIGIT


def word_borders(data: np.ndarray) -> np.ndarray:
    """Where words and the white space between them begin in a plain lower-case text, and its end, by ``PATTERN``."""
    kind = CLASS[data]
    border = np.ones(len(data) + 1, bool)
    border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # One apostrophe takes the letters behind it that the pattern names.
    quote = np.flatnonzero((data[:-1] == ord("'")) & border[:-2] & (kind[1:] == LETTER))
    after = np.r_[data, np.zeros(2, np.uint8)]
    one, two = after[quote + 1], after[quote + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    border[quote[short | long] + 1] = False
    border[quote[short] + 2] = border[quote[long] + 3] = True
    return np.flatnonzero(border)


class Store(dict):
    """Ids by string, made where they are missing."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, name: str) -> bytes:
        ids = self.old.get(name)
        if ids is None:
            ids = self.make(name)
        if len(name) <= LONGEST_KEPT:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[name] = ids
        return ids


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        splits = json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("pretokenizers", [{}])
        self.by_words = splits[0].get("pattern") == {"Regex": PATTERN}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x17F) if PLAIN.fullmatch(chr(c))}
        self.model = self.tokenizer.model
        self.words = Store(self.alone)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def alone(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word):
            return self.whole(word)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(word.translate(self.letters))])

    def plain(self, lowered: str) -> bytes:
        words = WORD.findall(lowered)
        ids = list(map(self.words.get, words))
        if None in ids:
            ids = [self.words[word] if own is None else own for own, word in zip(ids, words)]
        return b"".join(ids)

    def together(self, lowered: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        parts = [text.encode() for text in lowered]
        raw = b"\n".join([*parts, b""])
        data = np.frombuffer(raw, np.uint8)
        borders = word_borders(data)
        told = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        known = [b"" if word.isspace() else self.words[word] for word in told.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = told.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[at])
        begins = ends - sizes[at]
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first[at] - begins, sizes[at]) + np.arange(ends[-1])].tobytes()
        # A text ends at a line feed of ours, which may be in the middle of white space.
        text_ends = np.cumsum([len(part) + 1 for part in parts]) - 1
        cuts = [0, *(4 * np.r_[begins, ends[-1]][np.searchsorted(borders, text_ends)]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text in order."""
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            plain = self.by_words and "<|" not in text and PLAIN.fullmatch(text)
            held.append(text.lower() if plain else self(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._done(held)
                held, size = [], 0
        yield from self._done(held)

    def _done(self, held: list[str | bytes]) -> Iterator[bytes]:
        plain = [text for text in held if isinstance(text, str)]
        ids = iter(self.together(plain) if plain else ())
        return (next(ids) if isinstance(text, str) else text for text in held)

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            return self.whole(text)
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.plain(text.lower())
        if OTHERWISE.search(text):
            return self.whole(text)
        return b"".join([self.plain(s.lower()) if PLAIN.fullmatch(s) else self.words[s] for s in text.split()])


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    return Encoder(vocabulary)
