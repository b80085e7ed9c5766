"""A byte-level BPE vocabulary file, loaded once per Python process."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
import tiktoken

DEFAULT_PATH = public_tokenizers.path("byte_bpe_50k.json")
#: A blank or line feed after a letter or digit: no pre-token holds white space behind another character, so a pre-token
#: ends here whatever stands before or after.
STABLE = re.compile(r"[^\W_](?=[ \n])")
#: the vocabulary's pattern for the regex package, whose \\s also takes the separators U+001C to U+001F
PRE_TOKEN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: pre-tokens longer than this are encoded by halves
LEAF_BYTES = 2048


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encodes like the tokenizers library with the same file; special strings in a text become special ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        first = len(ranks) - len(merged)
        if any(spec["model"]["vocab"][m] != first + i for i, m in enumerate(merged)):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.special = special
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        table = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]
        self.pieces = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; long unsplit stretches go through ``encode_piece``."""
        if len(text) <= LEAF_BYTES or max(map(len, text.split()), default=0) <= LEAF_BYTES // 4 and not _long_gap(text):
            return self.core.encode(text, allowed_special="all")
        return list(chain.from_iterable(self._by_pre_token(text)))

    def pre_tokens(self, text: str):
        """(is_special, piece) of a text in order."""
        at = 0
        for m in [*(self.pieces.finditer(text) if self.pieces else ()), None]:
            end = m.start() if m else len(text)
            for piece in regex.finditer(PRE_TOKEN, text[at:end]):
                yield False, piece.group()
            if m:
                yield True, m.group()
                at = m.end()

    def _by_pre_token(self, text: str):
        for is_special, piece in self.pre_tokens(text):
            yield [self.special[piece]] if is_special else self.encode_piece(piece.encode())

    def encode_piece(self, piece: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        """Ids of one pre-token: halves are encoded apart and joined."""
        if len(piece) <= leaf:
            return self.core._encode_single_piece(piece)
        middle = len(piece) // 2
        return self.join(self.encode_piece(piece[:middle], leaf), self.encode_piece(piece[middle:], leaf))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two encoded stretches of one pre-token, as if encoded together.

        A sequence of ids is the encoding of its bytes exactly if every two neighbours are. So a window around the join
        is encoded anew until its first and last id are those that stood there: all neighbours are then right.
        """
        width = 8
        while True:
            a, b = left[-width:], right[:width]
            window = self.core._encode_single_piece(self.decode_bytes([*a, *b]))
            open_left, open_right = width < len(left), width < len(right)
            if (not open_left or window[0] == a[0]) and (not open_right or window[-1] == b[-1]):
                return [*left[:-width], *window, *right[width:]]
            width *= 2

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def lengths(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes_of])


def _long_gap(text: str) -> bool:
    """Is there a run of blanks of one kind too long to be left to the plain encoder?"""
    return any(c * LEAF_BYTES in text for c in " \n\t\r")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)
