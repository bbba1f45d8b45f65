"""Token ids of whole texts, made by a public tokenizer chunk by chunk.

Both pre-tokenizers cut a text at white space whatever stands around it, so the ids of a text are
those of its chunks, one after another. No chunk ends inside a special token: it has no white space,
and a chunk that holds a ``<`` goes on to the next white space. Chunks repeat a lot; each worker keeps the ids of those it
has met of late, at most twice ``REMEMBERED`` and those of one batch. Texts with characters that Python and the tokenizer may class
differently go to the tokenizer whole.

Where the tokenizer drops white space and marks the end of each word in its vocabulary, a text is cut at
white space alone, which is quicker, and only words not met before are cut into chunks. New chunks of
letters are encoded as one text then, joined by blanks.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

# Chunks remembered in each of two generations.
REMEMBERED = 350_000
# New chunks that are encoded as one text.
GROUP = 256
# Letters of Latin-1. A chunk ends after them where white space or one of these marks follows: for
# both tokenizers a piece of letters ends there. Apostrophes and combining marks are not among them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r".,!?;:|"
BYTE_LEVEL = re.compile(rf"\s*[{_LETTERS}]+(?![^\s{_MARKS}])|[{_MARKS}]+(?!\S)|\s*\S+|\s+")
WORD_LEVEL = re.compile(rf"[{_LETTERS}]+(?![^\s{_MARKS}#$%&*])|[{_MARKS}#$%&*]+(?!\S)|\S+")
ONE_WORD = re.compile(rf"[{_LETTERS}]+")
ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"


class Encoder:
    """Encodes texts with the tokenizer in ``path``, nothing else set, as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, chunks: re.Pattern):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = chunks.findall
        # A special token cuts a text before anything else is done to it, and no chunk without its text
        # has its id: it may stand between chunks.
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.mark_id, self.mark = special[0] if special else (None, "")
        #: What was met of late, and what was met before. Chunks that come again stay.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if not self.mark:
            return self._each(chunks)
        groups = [chunks[k : k + GROUP] for k in range(0, len(chunks), GROUP)]
        joined = self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for group, encoded in zip(groups, joined):
            ids = array("I", encoded.ids)
            cuts = (np.flatnonzero(np.frombuffer(ids, "<u4") == self.mark_id) * 4).tolist()
            if len(cuts) != len(group) - 1:
                out += self._each(group)  # a chunk that has the mark itself
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [[t] if any(c in t for c in ODD) else self.chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        unknown = set().union(*pieces).difference(self.known) if pieces else set()
        again = unknown.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        new = list(unknown - again)
        self.known.update(zip(new, self._ids(new)))
        ids = self.known.__getitem__
        return [b"".join(map(ids, p)) for p in pieces]


class WordEncoder(Encoder):
    """An encoder for a tokenizer that drops white space, lower-cases and ends each word with ``</w>``."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        super().__init__(path, WORD_LEVEL)
        self.parts, self.chunks = self.chunks, self._words
        # For words of lower-case Latin-1 letters between blanks, nothing else of both steps has an effect.
        self.plain = type(self.tokenizer).from_file(path)
        self.plain.normalizer = None
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    @staticmethod
    def _words(text: str) -> list[str]:
        # A special token is one in its own case only, and has a "<".
        return (text.lower() if text.isascii() and "<" not in text else text).split()

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin-1 letters, each of which is one word to the tokenizer as well."""
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        out: list[bytes] = []
        for group, encoded in zip(groups, self.plain.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cuts) != len(group):
                out += self._each(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
        return out

    def _pieces(self, word: str) -> list[str]:
        if any(c in word for c in ODD):
            return [word]
        return self.parts(word)

    def _ids(self, words: list[str]) -> list[bytes]:
        letters = {w for w in words if w.isascii() and w.isalpha()}
        others = {w: self._pieces(w) for w in words if w not in letters}
        wanted = set().union(*others.values()) - letters
        met = {c: i for c in wanted if (i := self.known.get(c) or self.older.get(c)) is not None}
        wanted.difference_update(met)
        own = [*filter(ONE_WORD.fullmatch, wanted)]
        rest = list(wanted.difference(own))
        own += letters
        met.update(zip(own, self._letters(own)))
        met.update(zip(rest, super()._ids(rest)))
        met.update({w: b"".join([met[c] for c in p]) for w, p in others.items()})
        return [met[w] for w in words]


@lru_cache(maxsize=2)
def encoder(path: str, byte_level: bool) -> Encoder:
    """One encoder per Python worker and tokenizer."""
    if byte_level:
        return Encoder(path, BYTE_LEVEL)
    return WordEncoder(path)
