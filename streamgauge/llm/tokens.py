"""Token ids of whole texts by the ``tokenizers`` library, with the ids of words kept.

Both public vocabularies split a text into words before they merge bytes, and the ids of a word do not depend on its
neighbours. So a text is cut at white space, each distinct word is encoded once by the library's model, and its ids (as
little-endian 32-bit integers) are kept for the next time in a table of bounded size. The result equals
``Tokenizer.encode(text, add_special_tokens=False)`` of the file as it is: contents of added tokens (``<|endoftext|>``) are
these tokens. Texts that hold one go to the library whole. Texts with unusual white space or letters take slower paths with the same
result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np
import regex

#: Unicode's white space, as the library's patterns take it (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DOUBLED = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: The vocabularies' own word patterns (fixed values, from the tokenizer files).
_BYTE_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Below this, Python's and the library's lower case and character classes agree.
_PLAIN = "\u0130"
#: Punctuation that ends many words.
_ENDS = frozenset(".,;:!?")
#: Longer words are encoded each time, so that the table is bounded in bytes too.
_LONGEST = 48
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


def _whole(tokenizer, text: str) -> bytes:
    return _packed(tokenizer.encode(text, add_special_tokens=False).ids)


def _added(tokenizer) -> list[str]:
    """Contents of the added tokens; both public files match them in the text before it is normalized."""
    found = tokenizer.get_added_tokens_decoder().values()
    if any(t.normalized for t in found):
        raise ValueError("added tokens matched in normalized text")
    return [t.content for t in found]


class _Table(dict):
    """Ids by string, of at most ``most`` strings of at most ``_LONGEST`` characters; emptied when full."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= _LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class _Pieces(_Table):
    """Ids of a piece that the model merges on its own."""

    def __init__(self, model, most: int):
        super().__init__(most)
        self.tokenize = model.tokenize

    def ids(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in self.tokenize(piece)])

    def __missing__(self, piece: str) -> bytes:
        return self.keep(piece, self.ids(piece))


class ByteEncoder(_Table):
    """Byte-level vocabulary. Keys: a word with a blank before it (kept without the blank), or a line feed and a word."""

    def __init__(self, path: str, most: int = 1_200_000):
        super().__init__(most)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = _added(self.tokenizer)
        self.pieces = _Pieces(self.tokenizer.model, most // 4)
        self.line_feed = self.pieces["\n"]

    def _of(self, chunk: str) -> bytes:
        p = self.pieces
        if chunk.isalpha():
            return p.ids(chunk)
        return b"".join([p[x] for x in _BYTE_PIECE.findall(chunk)])

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():
            ids = self.pieces.ids(" " + key)
        elif key[:1] == "\n":
            ids = self.line_feed + self._of(key[1:])
        elif key[-1:] in _ENDS and key[:-1].isalpha():
            ids = self[key[:-1]] + self.pieces[key[-1]]
        else:
            ids = self._of(" " + key)
        return self.keep(key, ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return _whole(self.tokenizer, text)
        if any(x in text for x in _DOUBLED) or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and _OTHER_SPACE.search(text):
            return b"".join([self._odd(c) for c in _CHUNK.findall(text)])
        words = text.replace("\n", " \n").split(" ")
        return self._of(words[0]) + b"".join(map(self.__getitem__, words[1:]))

    def _odd(self, chunk: str) -> bytes:
        if chunk[0] == " " and len(chunk) > 1 and not chunk.isspace():
            return self[chunk[1:]]
        return b"".join([self.pieces[x] for x in _BYTE_PIECE.findall(chunk)])


class WordEncoder(_Table):
    """Vocabulary with word ends, lower case, white space dropped. Keys: words between white space."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(most)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = _added(self.tokenizer)
        self.pieces = _Pieces(self.tokenizer.model, most // 4)

    def __missing__(self, word: str) -> bytes:
        if word[-1] in _ENDS and word[:-1].isalpha():
            ids = self[word[:-1]] + self.pieces[word[-1]]
        elif word.isascii() or max(word) < _PLAIN:
            plain = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
            ids = self.pieces.ids(plain) if plain.isalpha() else b"".join([self.pieces[x] for x in _WORD_PIECE.findall(plain)])
        else:
            ids = _whole(self.tokenizer, word)
        return self.keep(word, ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return _whole(self.tokenizer, text)
        if any(c in text for c in _CONTROLS) or not text.isascii() and "\u180e" in text:
            return _whole(self.tokenizer, text)
        return b"".join(map(self.__getitem__, text.split()))


_OPEN: dict[tuple[str, str], dict] = {}


def encoder(kind: str, path: str):
    """The encoder of this worker process, kept from task to task."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = {"byte": ByteEncoder, "word": WordEncoder}[kind](path)
    return _OPEN[kind, path]


def size_of(path: str) -> int:
    """Number of ids of a vocabulary file, added tokens included."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return max([t.get_vocab_size(), *(i + 1 for i in t.get_added_tokens_decoder())])


def public(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
