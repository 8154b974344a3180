"""Byte-level BPE encoding with a bounded memory of words seen before."""

from __future__ import annotations

import json
import os
import re
import string
from array import array

import numpy as np

from tidewright.llm._common import held

#: Letters and marks between which the pre-tokenizer always parts a text, as it
#: does before a run of the four blanks: a text may be cut there.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
CHUNK = re.compile(rf"[ \n\t\r]*[{LETTERS}]+(?=[ \n\t\r{MARKS}]|\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space besides the four blanks, of which a cut might not be a token border.
OTHER_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Where two blanks meet or others than space and newline are, a text is cut by the pattern.
BLANK_PAIRS = ("  ", "\n ", " \n", "\n\n", "\t", "\r")
#: Stands in a key for the lack of a space before the piece.
BARE = "\x0b"
KEPT_CHARS = 64
#: ASCII marks and symbols: a run of them after a letter or digit, at a word's end, is a pre-token of its own.
ENDS = string.punctuation
END_SET = frozenset(ENDS)


#: Pieces that are one pre-token, with a space before them or without.
SINGLE = re.compile(rf"[{LETTERS}]+|[0-9]+|[{MARKS}]+|\n")


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class Known(dict):
    """Ids of the words met since the last turn of generations; a missing word comes from the older or is encoded."""

    def __init__(self, coder: Encoder, old: dict) -> None:
        super().__init__()
        self.coder, self.old = coder, old

    def __missing__(self, w: str) -> bytes:
        if w[-1:] in END_SET:
            stem = w.rstrip(ENDS)
            if stem and stem[-1].isalnum():
                return self[stem] + self[BARE + w[len(stem) :]]
        got = self.old.get(w)
        if got is None:
            got = self.coder.word(w)
            if len(w) > KEPT_CHARS:
                return got
        self[w] = got
        return got


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, the tokenizer's own ids.

    ``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``;
    with ``special_as_text`` strings of special tokens inside a text are
    ordinary text. Words are encoded once and remembered in two generations:
    when the younger holds ``memory`` words, the older, whose words had no use
    since, is let go. Words over 64 characters are never kept, so memory is
    bounded. Texts are cut at single spaces and newlines, those with other
    blanks by a pattern; a word that is one pre-token goes to the tokenizer's
    model at once. Texts with rare white space (where a cut might not be a token
    border) or with an added token's string are encoded whole, and so are all
    texts where the tokenizer is no plain byte-level one.
    """

    def __init__(self, path: str, memory: int = 120_000, special_as_text: bool = False) -> None:
        # a task has one core; threads of the tokenizer's own only wait for one another
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        said = json.loads(self.tokenizer.to_str())
        before = said.get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.added = [t["content"] for t in said.get("added_tokens", []) if not (special_as_text and t["special"])]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memory, self.known = memory, Known(self, {})

    def word(self, w: str) -> bytes:
        """Ids of a key: a piece with a space before it, or without one where BARE stands."""
        if w.isascii() and w.isalpha():
            return array("I", [t.id for t in self.model.tokenize("\u0120" + w)]).tobytes()
        bare = w[:1] == BARE
        text = w[1:] if bare else " " + w
        if SINGLE.fullmatch(w, 1 if bare else 0):
            coded = text.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def raw(self, text: str | None) -> bytes:
        text = text or ""
        if not self.plain or any(c in text for c in OTHER_BLANKS) or any(a in text for a in self.added):
            return self._whole(text)
        if any(b in text for b in BLANK_PAIRS):
            words = [BARE + c for c in CHUNK.findall(text)]
        else:
            words = (BARE + text.replace("\n", f" {BARE}\n {BARE}")).split(" ")
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > self.memory:
            self.known = Known(self, dict(self.known))
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


def encoder(path: str) -> Encoder:
    """A worker process's encoder of a file."""
    return held(("tokenizer", path), lambda: Encoder(path))
