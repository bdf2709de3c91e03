"""Token ids of whole texts from the tokenizers library, with a cache of words in each Python worker.

A text is cut where white space follows other characters. In both vocabularies no token spans such a place, so
the ids of the pieces, joined, are the ids of the text. Pieces recur, so most cost one dictionary lookup. The
pieces that are new go to the vocabulary's own BPE model after the pre-tokenisation that its file states; anything
outside Latin script goes through the whole tokenizer instead, as does a whole text with the string of an added token in it:
by the file's defaults that is the token's single id. A vocabulary of another pre-tokenisation than these two goes through the
whole tokenizer, text by text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

#: White_Space of Unicode, as the patterns of the tokenizers read \s. Python's own \s has four more characters.
_W = "\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_PIECES = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")
#: A text with one of these is cut by _PIECES, not at single spaces and line ends: white space in a row, or of another kind.
_ODD = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\f\r")
_ODD_WIDE = tuple(c for c in _W if not c.isascii())
#: Characters from here on take the whole tokenizer (normal forms and case have special rules there).
_BEYOND = "ɐ"
#: Normalisation and pre-tokenisation of the vocabularies whose words are cached (fixed values, as their files state them).
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_FORMS = (
    (None, _BYTES | {"use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [_CUT, _BYTES | {"use_regex": False}]},
    ),
)
#: Words kept by a worker, about 200 bytes each.
CACHE_WORDS = 700_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Piece of text to the bytes of its ids. lead: what stands before the piece in the text."""

    def __init__(self, ids: "Ids", lead: str):
        super().__init__()
        self.ids, self.lead = ids, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self.ids.of_piece(self.lead + word)
        if len(word) < 64:
            self[word] = got
        return got


class Ids:
    """encode(text) gives the ids as little-endian bytes of self.dtype, the narrowest that holds the vocabulary."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        # Case is ignored as a token may be sought in the normalised text; a text that only seems to hold one just takes longer.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        lead = os.path.commonprefix(added)
        self.lead = lead if not any(map(str.isalpha, lead)) else lead[: next(k for k, c in enumerate(lead) if c.isalpha())]
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        file = json.loads(self.whole.to_str())
        self.known = (file["normalizer"], file["pre_tokenizer"]) in _FORMS and file["model"]["type"] == "BPE"
        self.spaced = self.whole.normalizer is None  # the byte-level vocabulary keeps white space and case
        self.letters = _byte_letters()
        # The pre-tokenisation that each vocabulary's file states (fixed patterns).
        self.cut = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            if self.spaced
            else r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        )
        self.parts: dict[str, bytes] = {}
        self.first, self.after, self.line = _Words(self, ""), _Words(self, " "), _Words(self, "\n")
        if not self.spaced:  # white space is dropped, so what leads a word does not matter
            self.after = self.line = self.first

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def of_piece(self, piece: str) -> bytes:
        if "<|" in piece or (not piece.isascii() and max(piece) >= _BEYOND):
            return self._whole(piece)
        if not self.spaced:
            piece = piece.lstrip(_W).lower()
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():  # the usual cases, as the pattern would cut them
            parts = (piece,)
        elif word[-1:] in (",", ".") and word[:-1].isalpha():
            parts = (piece[:-1], piece[-1])
        else:
            parts = self.cut.findall(piece)
        out, known = [], self.parts
        for part in parts:
            got = known.get(part)
            if got is None:
                got = array(self.code, [t.id for t in self.model.tokenize(self.lettered(part))]).tobytes()
                if len(known) >= CACHE_WORDS:
                    known.clear()
                if len(part) < 64:
                    known[part] = got
            out.append(got)
        return b"".join(out) if len(out) != 1 else out[0]

    def lettered(self, part: str) -> str:
        """A part in the byte-level alphabet."""
        if part.isascii() and part.isprintable():
            return part.replace(" ", self.letters[32])
        return part.encode().decode("latin-1").translate(self.letters)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or (self.lead in text and self.added.search(text)):  # an added token may take white space or end a word
            return self._whole(text)
        odd = any(x in text for x in _ODD) or (not text.isascii() and any(x in text for x in _ODD_WIDE))
        if odd or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.first.__getitem__, _PIECES.findall(text)))
        out = []
        after = self.after.__getitem__
        for k, line in enumerate(text.split("\n")):
            word, *rest = line.split(" ")
            out.append((self.line if k else self.first)[word])
            out.extend(map(after, rest))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each vocabulary and Python worker."""
    return Ids(path)
