"""A byte-level BPE tokenizer file: its split of texts into pieces, its special strings, vocabulary and merges.

The file's path is a parameter; workers load it once.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import regex

#: The characters with the White_Space property, as the split knows them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split of byte-level BPE: contractions, letters, numbers, other runs, white space.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenizerFile:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, split = spec["model"], spec["pre_tokenizer"]
        if kind["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"] or spec["post_processor"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.vocab: dict[str, int] = kind["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: dict[int, bytes] = {i: bytes(map(byte_of.__getitem__, s)) for s, i in self.vocab.items()}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [self.vocab[letters[b]] for b in range(256)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        #: (left id << 32 | right id) -> (rank, merged id)
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self._find = regex.compile(SPLIT).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def split(self, text: str) -> list[str]:
        """The pieces of a whole text; a special string in it is a piece of its own."""
        if self._cut and any(s in text for s in self.special):
            return list(chain.from_iterable([part] if part in self.special else self._find(part) for part in self._cut(text) if part))
        return self._find(text)


@lru_cache(maxsize=4)
def load(path: str) -> TokenizerFile:
    return TokenizerFile(path)
