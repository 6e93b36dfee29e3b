"""Fast whole-text encoding with a byte-level BPE file of the tokenizers library.

The pre-tokenizer of such a file parts a text before every single blank and
around every single line feed that stand between other characters.  What lies
between (a chunk) is encoded once by the library and then looked up.  A text
with runs of white space or an added token's string goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Chunks that a worker remembers; then it starts afresh.
REMEMBERED = 1_000_000
#: Letters, a number, or signs, with a blank in front or not; Latin letters only.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class _Spaced(Exception):
    """The chunk can't be encoded without what is around it."""


@lru_cache(1)
def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Chunks(dict):
    """Chunk -> its ids as 16-bit integers."""

    def __init__(self, encoder: Encoder, prefix: str) -> None:
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[chunk] = self.encoder.chunk(self.prefix + chunk) if PLAIN.fullmatch(chunk) else self.encoder.odd(self.prefix, chunk)
        return found


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the ids do not fit 16 bits")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or parts["truncation"] or parts["padding"]:
            raise ValueError("not a plain byte-level tokenizer: texts can't be parted before they are encoded")
        self.first, self.other = _Chunks(self, ""), _Chunks(self, " ")
        self.blank = self.letters[0x20]
        self.short: dict[str, bytes] = {}
        self.line_feed = self.whole("\n")

    def piece(self, piece: str) -> bytes:
        """What the model makes of one pre-token."""
        mapped = piece.replace(" ", self.blank) if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def chunk(self, text: str) -> bytes:
        """A chunk of Latin letters, numbers and signs, with or without a blank in front."""
        pieces = PIECES.findall(text)
        if len(pieces) == 1:
            return self.piece(text)
        out = []
        for piece in pieces:
            if len(piece) < 3:
                if piece not in self.short:
                    self.short[piece] = self.piece(piece)
                out.append(self.short[piece])
            else:
                # the word may stand alone elsewhere
                spaced = piece[0] == " "
                known = (self.other if spaced else self.first).get(piece[spaced:])
                out.append(known if known is not None else self.piece(piece))
        return b"".join(out)

    def odd(self, prefix: str, chunk: str) -> bytes:
        """Any other chunk: the library takes it whole, or all of the text."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace() or len(chunk.split()) != 1:
            raise _Spaced
        return self.whole(prefix + chunk)

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as 16-bit integers."""
        if not text:
            return b""
        if not any(a in text for a in self.added):
            try:
                out = []
                for line in text.split("\n"):
                    head, *tail = line.split(" ")
                    out.append(self.first[head] + b"".join(map(self.other.__getitem__, tail)))
                return self.line_feed.join(out)
            except _Spaced:
                pass
        return self.whole(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget(path: str) -> None:
    """Drops the chunks that a worker remembers."""
    if encoder.cache_info().currsize:
        encoder(path).first.clear(), encoder(path).other.clear()
