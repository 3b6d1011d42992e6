"""Pre-tokens of the public byte-level BPE vocabularies, and bounded caches of their pieces' ids."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: The public pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_ANY = regex.compile(PATTERN)
# The same classes spelled out for texts below U+0100, which the standard library matches about twice as fast.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(
    f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+| ?[{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OUTSIDE = re.compile("[^\x00-\x1b -\xff]")  # beyond Latin-1, or U+001C to U+001F, on whose class the libraries differ


def pretokens(text: str) -> list[str]:
    """The matches of PATTERN in order; their concatenation is the text."""
    return (_ANY if _OUTSIDE.search(text) else _LATIN).findall(text)


def boundaries(text: str) -> list[int]:
    """Start offsets of the pre-tokens."""
    return [m.start() for m in (_ANY if _OUTSIDE.search(text) else _LATIN).finditer(text)]


class Pieces:
    """A bounded dict from pre-token to its ids as unsigned 32-bit integers; results never depend on what it holds."""

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes]], limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its pre-tokens; what is new in any of the texts is encoded at once."""
        if len(self.known) > self.limit:
            self.known.clear()
        missing = set().union(*texts).difference(self.known)
        if missing:
            self.known |= self.encode(list(missing))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]


def library_pieces(tokenizer, pieces: list[str], together: int = 1_000) -> dict[str, bytes]:
    """The library's ids of each pre-token.

    Pre-tokens are encoded many at a time as one text that splits into the same pre-tokens: those of a space and what
    follows it one after the other, where a token that begins with the space begins the next one; those without white
    space after a line feed each, where the line feed's token does. The few others are encoded one by one.
    """
    begins, feed = _begins(tokenizer), tokenizer.token_to_id("\u010a")
    spaced = [p for p in pieces if len(p) > 1 and p[0] == " " and not p[1].isspace()]
    solid = [p for p in pieces if not p[0].isspace()] if feed is not None else []
    out: dict[str, bytes] = {}
    for some, lead in ((spaced, ""), (solid, "\n")):
        runs = [some[i : i + together] for i in range(0, len(some), together)]
        for run, e in zip(runs, tokenizer.encode_batch_fast([lead + lead.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            starts = np.flatnonzero(ids == feed if lead else begins[ids])
            if len(starts) == len(run):
                data, first = ids.tobytes(), 4 * (starts + len(lead))
                out.update(zip(run, map(data.__getitem__, map(slice, first.tolist(), [*(4 * starts[1:]).tolist(), 4 * len(ids)])), strict=True))
    rest = [p for p in pieces if p not in out] if len(out) < len(pieces) else []
    out.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
    return out


@lru_cache(2)
def _begins(tokenizer) -> np.ndarray:
    """Which ids stand for tokens that begin with a space."""
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.startswith("\u0120")
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def library_tokenizer(path: str):
    """The tokenizers library's object for a .json file, with its default handling of special strings."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
