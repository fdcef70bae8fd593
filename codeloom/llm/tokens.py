"""Tokenising whole texts with a bounded memo in front of the tokenizers library.

Both vocabularies split a text before any merge, never across the gap between
two words nor between letters and the marks after them. Where a text's white
space is plain (single spaces and line breaks between words), it is cut at the
gaps and each distinct piece is tokenised once; every other text goes to the
library whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Texts with any of these are given to the library whole: white space that the
#: split patterns treat as a run, and what may be an added token. Characters are
#: searched by one class and runs as plain strings: as alternatives of a single
#: pattern they take longer than all lookups of the text's pieces.
UNPLAIN = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
UNPLAIN_RUNS = ("  ", " \n", "\n ", "\n\n", "<|")
#: A word of Latin letters (each one code point under NFC) and marks after it.
LETTERS = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+)([.,!?;:&%$*#|]*)")
#: Pieces that are remembered at once, and the most characters of one. Half of
#: them are the older ones, which go together once the younger half is full; those
#: that were met again meanwhile are young. A worker outlives its tasks and its
#: memo stays with it, so the bound counts for every later stage as well.
MEMO_PIECES = 1_200_000
MEMO_LENGTH = 64


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself
    where it is printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(free)) for b in range(256))


def is_plain(text: str) -> bool:
    """Whether a text (not the empty one) may be cut at its gaps."""
    return not (text[0] in " \n" or text[-1] in " \n" or any(run in text for run in UNPLAIN_RUNS) or UNPLAIN.search(text))


class Memo(dict):
    """Ids by piece; a piece that is not held is asked for."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        return self.ask(piece)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    `words_alone` says that the vocabulary drops white space and case, so that a
    word has the same ids wherever it stands; else a piece is a word with the
    space or line break before it.
    """

    def __init__(self, path: str, pieces: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model, self.letters = self.library.model, _byte_letters()
        self.words_alone = self._whole("a b") == self._whole("a  B")
        self.memo = Memo(self._recall)
        self.pieces = pieces or MEMO_PIECES
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.line = b"" if self.words_alone else self._whole("\n")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def _whole(self, text: str) -> bytes:
        """Ids by the whole library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, text: str) -> bytes:
        """Ids by the library's merges alone, for what its split leaves whole."""
        spelled = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _recall(self, piece: str) -> bytes:
        """Ids of a piece that is among the older ones or new."""
        if 2 * len(self.memo) + 4 > self.pieces:  # learning adds a piece and its core
            self.older.clear()
            self.older.update(self.memo)
            self.memo.clear()  # the same object: lookups of a text may be under way
        ids = self.older.get(piece)
        if ids is None:
            return self._learn(piece)
        self.memo[piece] = ids
        return ids

    def _learn(self, piece: str) -> bytes:
        memo, marks = self.memo, self.marks
        if len(piece) > MEMO_LENGTH or not (m := LETTERS.fullmatch(piece)):
            ids = self._whole(piece if self.words_alone or piece[:1] == "\n" else " " + piece)
            if len(piece) <= MEMO_LENGTH:
                memo[piece] = ids
            return ids
        line, word, after = m.groups()
        core = word.lower() if self.words_alone else line + word
        ids = None if core == piece else memo.get(core) or self.older.get(core)
        if ids is None:
            ids = self._word(core) if self.words_alone else self.line + self._word(word) if line else self._word(" " + word)
        memo[core] = ids
        if after not in marks:
            marks[after] = self._whole(after)
        memo[piece] = ids = ids + marks[after]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        skip, ids_of = len(self.line), self.memo.__getitem__  # the line break put before the text
        for text in texts:
            if not text:
                out.append(b"")
            elif not is_plain(text):
                out.append(self._whole(text))
            else:
                pieces = text.replace("\n", " ").split(" ") if self.words_alone else ("\n" + text).replace("\n", " \n")[1:].split(" ")
                out.append(b"".join(map(ids_of, pieces))[skip:])
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pieces: int | None = None) -> Encoder:
    """The process's encoder for a vocabulary file; its memo outlives a task."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = Encoder(path, pieces)
    return _encoders[path, pieces]


def slices(sizes: list[int], most_rows: int = 400, most_size: int = 4 << 20):
    """Consecutive (start, end) of rows, bounded by rows and by their total size."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most_rows or held + n > most_size):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
