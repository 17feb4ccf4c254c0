"""Exact token ids from a public tokenizer file, with a bounded cache of its pieces.

Both supported files split a text into pieces first and merge inside a piece only, so the ids of a text are
the ids of its pieces in order. A text of Latin letters, digits and common punctuation is cut here, and each new
piece goes through the library's model once; any other text goes to the library whole, and so does one that may
hold the string of a special token.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CACHED_PIECES = 1_000_000
#: Every special token of the supported files starts so.
SPECIAL = "<|"
#: Where this module's cut and the library's agree beyond doubt: no rare spaces, no combining marks, no special case pairs.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ž‐-‧‰-⁞]*")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Fixed by the two tokenizer files.
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level models: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Pieces(dict[str, bytes]):
    """The ids of each piece; a missing one is merged by the library's model."""

    def __init__(self, merge: Callable[[str], list]) -> None:
        self.merge, self.letters = merge, byte_letters()
        self.visible = {b: c for b, c in enumerate(self.letters[:128]) if chr(b) != c}

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.translate(self.visible) if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = b"".join([token.id.to_bytes(4, "little") for token in self.merge(spelled)])
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, as the library gives them without added tokens.

    special_as_text: strings of special tokens in a text are ordinary text; else they become their tokens.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, after = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.pieces, self.lower = None, False
        if before is None and after.get("type") == "ByteLevel" and after.get("use_regex") and not after.get("add_prefix_space"):
            self.pieces = BYTE_PIECES
        elif WORD_RULE in json.dumps(after).replace("\\\\", "\\") and "Lowercase" in json.dumps(before):
            self.pieces, self.lower = WORD_PIECES, True
        if not all(x["content"].startswith(SPECIAL) for x in spec.get("added_tokens", [])):
            self.pieces = None
        self.known = Pieces(self.library.model.tokenize)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or SPECIAL in text or not PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text.lower() if self.lower else text)))


def each_text(encode: Callable[[str | None], bytes], texts: pa.Array, rows: int = 512) -> Iterator[bytes]:
    """The ids of each text of an Arrow array, of which so many are Python strings at a time."""
    for start in range(0, len(texts), rows):
        yield from map(encode, texts.slice(start, rows).to_pylist())


@cache
def encoder(tokenizer: str, special_as_text: bool = False) -> Encoder:
    """tokenizer: a path, or the name of a file that the public_tokenizers package holds on every machine."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Encoder(tokenizer, special_as_text)
