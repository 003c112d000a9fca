"""Token ids of whole texts by the tokenizers library, from inside Spark tasks.

A byte-level BPE vocabulary of this family cuts a text into pieces before it merges, and a space
that a non-space follows always begins a piece.  So a text can be cut at those spaces and each
word encoded once per worker; `Encoder` keeps a bounded cache of words and gives exactly the ids
that `Tokenizer.encode(text, add_special_tokens=False)` gives (tests compare them).
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ɏ]*")
_INNER = re.compile(r" (?=\S)")
# Words that may stand in one string with others: pieces of theirs that meet are of different kinds.
_JOINS = re.compile(r"[!-&(-~À-ÖØ-öø-ɏ]+")
_KINDS = re.compile(r"Ġ|Ġ?(?:(?:[A-Za-z]|[^!-~Ġ])+|[0-9]+|[!-/:-@[-`{-~]+)")
#: New words that the model merges in one call.
JOINED = 64


def _byte_names() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE vocabularies use for the 256 bytes."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Spaces(Exception):
    """A space that more white space or the end of the text follows."""


class Encoder(dict):
    """Maps a word to the ids of a space and that word, as little-endian 32-bit integers."""

    def __init__(self, path: str, words: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.names, self.words, self.longest = self.whole.model, _byte_names(), words, longest
        self.heads: dict[str, bytes] = {}
        added = {t.content for t in self.whole.get_added_tokens_decoder().values()}  # no merge makes these
        vocabulary = {t: i for t, i in self.whole.get_vocab().items() if t not in added}
        self.firsts = frozenset(i for token, i in vocabulary.items() if token[0] == "Ġ")
        # No token of characters that _JOINS words can hold runs over the end of a piece or of a word.
        held = re.compile("[Ġ!-&(-~" + "".join(re.escape(self.names[b]) for b in [*range(0x80, 0xC0), *range(0xC3, 0xCA)]) + "]+")
        self.joins = all(_KINDS.fullmatch(t) for t in vocabulary if held.fullmatch(t))

    def name(self, text: str) -> str:
        """The text as the vocabulary writes its bytes."""
        if text.isascii():
            return text.replace(" ", "Ġ").replace("\n", "Ċ")
        return text.encode().decode("latin-1").translate(self.names)

    def ids(self, unit: str) -> bytes:
        if _PLAIN.fullmatch(unit):
            out = [t.id for piece in _PIECES.findall(unit) for t in self.model.tokenize(self.name(piece))]
        else:
            out = self.whole.encode(unit, add_special_tokens=False).ids
        return _packed(out)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Spaces
        out = self.ids(" " + word)
        if len(word) <= self.longest:
            if len(self) >= self.words:
                self.clear()
            self[word] = out
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of a space and each of some new words, JOINED words in a call where that gives the same."""
        joins = [w for w in words if len(w) <= self.longest and _JOINS.fullmatch(w)] if self.joins else []
        found: dict[str, bytes] = {}
        for at in range(0, len(joins), JOINED):
            part = joins[at : at + JOINED]
            ids = [t.id for t in self.model.tokenize(self.name(" " + " ".join(part)))]
            starts = [4 * k for k, i in enumerate(ids) if i in self.firsts]
            packed = _packed(ids)
            found.update(zip(part, map(packed.__getitem__, map(slice, starts, starts[1:] + [len(packed)])), strict=True))
        if len(self) + len(found) > self.words:
            self.clear()
        self.update(found)
        for word in words:
            if word not in found:
                found[word] = self[word]
        return found

    def bodies(self, words: list[str]) -> bytes:
        """The ids of words that a space stands before."""
        out = list(map(self.get, words))
        if None in out:
            new = self.learn(list(dict.fromkeys([w for w, ids in zip(words, out, strict=True) if ids is None])))
            out = [new[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            body = self.bodies(rest)
        except _Spaces:
            head, *rest = _INNER.split(text)
            body = self.bodies(rest)
        if (first := self.heads.get(head)) is None:
            first = self.ids(head)
            if len(self.heads) >= self.words // 8:
                self.heads.clear()
            if len(head) <= self.longest:
                self.heads[head] = first
        return first + body


@lru_cache(maxsize=2)
def encoder(path: str, words: int = 400_000) -> Encoder:
    """The worker's encoder; workers are reused, so its cache serves many tasks."""
    return Encoder(path, words)
