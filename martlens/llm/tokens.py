"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit ids.

The tokenizers library does the encoding. A text is handed to it in the
pieces into which its own rules split a text anyway, and each worker remembers
what it said of a piece, because most words come again. That holds for
tokenizers that drop white space and encode runs of letters apart; for any
other file, and for words that these rules could treat otherwise, the library
gets the text or word as it is. Plain text is split into pieces at once, other
text into words first.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: Words and pieces of a generation that is remembered, and the longest one kept.
WORDS, PIECES, LONG = 200_000, 300_000, 64
_TAIL = b".,!?;:"
#: How the known tokenizer splits an ASCII word, in lower case (fixed by its file).
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: What a text holds that is not plain: other characters, or a special token. In plain
#: text (ASCII and Latin-1 letters) every character is its own normal form.
_ODD = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
#: How the known tokenizer splits plain text, in lower case (fixed by its file).
_PLAIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\t\\n\\r ]+"
)
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _alphabet() -> list[str]:
    """The letter that byte-level tokenizers write for each byte (a public, fixed rule).

    Printable bytes stand for themselves; the others take the letters from
    U+0100 on, in ascending order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


_ALPHABET = _alphabet()


class _Memory(dict):
    """What was worked out, in two generations: a full one becomes the old one.

    So memory is bounded, and what comes often is not worked out again.
    """

    def __init__(self, most: int) -> None:
        self.most, self.old = most, {}

    def __missing__(self, key):
        data = self.old.get(key)
        if data is None:
            data = self.work_out(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = data
        return data


class _Pieces(_Memory):
    """Ids of runs that the tokenizer's rules keep in one piece."""

    def __init__(self, model: object, n_ids: int) -> None:
        super().__init__(PIECES)
        self.tokenize = model.tokenize
        self.bytes_of = [struct.pack("<I", i) for i in range(n_ids)]

    def __missing__(self, piece: str) -> bytes:
        # As above, with little between the library and the memory.
        data = self.old.get(piece)
        if data is None:
            written = piece if piece.isascii() else "".join(_ALPHABET[b] for b in piece.encode())
            bytes_of = self.bytes_of
            data = b"".join([bytes_of[token.id] for token in self.tokenize(written)])
            if len(piece) > LONG:
                return data
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = data
        return data


class _Words(_Memory):
    """Ids of words, a word being what stands between ASCII white space."""

    def __init__(self, encoder: WordEncoder) -> None:
        super().__init__(WORDS)
        self.encoder = encoder

    def work_out(self, word: bytes) -> bytes:
        core = word.rstrip(_TAIL)
        pieces = self.encoder.pieces
        if core.isalpha():  # ASCII letters
            data = pieces[core.lower().decode()]
        else:
            run = core.decode("utf-8", "surrogatepass")
            if not (run.isalpha() and max(run) < "Ā"):
                if word.isascii() and b"<|" not in word and run.isprintable():
                    return b"".join(map(pieces.__getitem__, _ASCII.findall(word.decode().lower())))
                return self.encoder.whole(word.decode("utf-8", "surrogatepass"))
            data = pieces[run.lower()]
        return data + self[word[len(core) :]] if len(core) < len(word) else data


class WordEncoder:
    """Encodes texts by one tokenizer file."""

    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [part["type"] for part in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (
            normal == ["NFC", "Replace", "Lowercase"]
            and parts[0].get("pattern") == {"Regex": _SPLIT}
            and [part["type"] for part in parts] == ["Split", "ByteLevel"]
            and spec["model"]["type"] == "BPE"
        )
        self.pieces = _Pieces(self.tokenizer.model, self.tokenizer.get_vocab_size())
        self.words = _Words(self)

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The worker's encoder for a file, opened once."""
        if path not in WordEncoder._open:
            WordEncoder._open[path] = WordEncoder(path)
        return WordEncoder._open[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null or empty text has none."""
        look_up, of_piece = self.words.__getitem__, self.pieces.__getitem__
        for text in texts:
            if not text:
                yield b""
            elif self.by_word and not _ODD.search(text):
                yield b"".join(map(of_piece, _PLAIN.findall(text.lower())))
            elif self.by_word:
                yield b"".join(map(look_up, text.encode("utf-8", "surrogatepass").split()))
            else:
                yield self.whole(text)
