"""Token ids of whole texts by a public tokenizer file, with the ids of repeated words remembered."""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

#: A text falls apart before each single space that a non-space follows: byte-level BPE with the usual splitting
#: pattern never joins across it, so the parts' ids, one after another, are the text's ids.
_CUT = re.compile(r" (?=\S)")
_TWO_SPACES = re.compile(r" \s")
#: Marks that end a word: a run of them after letters is one pre-token of its own.
_ENDS = ".,!?;:|%#$*&"
#: Parts kept in the memory of one Python worker, and the longest part that is kept.
KEPT_PARTS, KEPT_LENGTH = 1_000_000, 40


def default_tokenizer() -> str:
    """Path of the 50k byte-level BPE among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself where printable, else the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Encoder:
    """Ids of texts as little-endian bytes, 2 a token where the vocabulary allows it, else 4.

    A null text has no ids. The strings of added tokens, such as an end of text, become their ids as in the library,
    whose splitting they change; texts that hold one are encoded whole. The tokenizer must be byte-level BPE whose
    splitting pattern takes a run of letters, with the space before it, as one pre-token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "<%dH" if self.dtype.itemsize == 2 else "<%dI"
        self.kept: dict[str, bytes] = {}  # parts after a space
        self.bare: dict[str, bytes] = {}  # others

    def _whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(self.code % len(ids), *ids)

    def _word(self, spelt: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(self.code % len(ids), *ids)

    def _piece(self, part: str, kept: dict[str, bytes], before: str) -> bytes:
        """Ids of ``before``, which is a space or nothing, and ``part``, which starts with a non-space or is a line's end."""
        if (ids := kept.get(part)) is not None:
            return ids
        word = part.rstrip(_ENDS)
        if word.isalpha():
            if len(word) != len(part):
                ids = self._piece(word, kept, before) + self._piece(part[len(word) :], self.bare, "")
            else:
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = self._word((self.space if before else "") + spelt)
        else:
            first, line, rest = part.partition("\n")
            if line and first and rest[:1].isalpha() and not first[-1].isspace():
                return self._piece(first, kept, before) + self._piece(line, self.bare, "") + self._piece(rest, self.bare, "")
            ids = self._whole(before + part)
        if len(part) <= KEPT_LENGTH:
            if len(kept) > (KEPT_PARTS if before else KEPT_PARTS // 4):
                kept.clear()
            kept[part] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self._whole(text)
        parts = text.split(" ") if _TWO_SPACES.search(text) is None else _CUT.split(text)
        head = self._piece(parts[0], self.bare, "") if parts[0] else b""
        if len(parts) == 1:
            return head
        if parts[-1] == "":  # the text ends in a space that nothing follows
            return self._whole(text)
        del parts[0]
        ids = list(map(self.kept.get, parts))
        if None in ids:
            ids = [self._piece(p, self.kept, " ") if x is None else x for p, x in zip(parts, ids, strict=True)]
        return head + b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder: later tasks in a worker go on with the words that earlier ones met."""
    return Encoder(path)
