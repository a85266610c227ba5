"""Byte-level BPE ids of whole texts inside Python workers."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A space before white space or the end: there a text's tokens aren't those of its parts.
RUN = re.compile(r" (?:\s|\Z)")


class ByteBpe:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, as the tokenizers library does.

    Latin-1 texts without special strings take tiktoken with the same vocabulary, which gives the same ids in a
    quarter of the time; all others go to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in self.library.get_vocab(False).items() if k not in special}
        self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(1 + max(self.library.get_vocab(True).values()), bool)  # ids whose text begins with a space
        self.spaced[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None

    def ids(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
            if not (self.special and self.special.search(text)):
                return self.fast.encode_ordinary(text)
        except UnicodeEncodeError:
            pass
        return self.library.encode(text, add_special_tokens=False).ids

    def counts(self, parts: list[str]) -> np.ndarray:
        """Ids of each part as it reads after a space; parts hold no spaces.

        A token that begins with the byte of a space begins a part, so many parts are encoded at once; those with other
        white space at an end, which could run into the next one's space, are encoded alone.
        """
        out = np.empty(len(parts), np.int64)
        alone = np.fromiter((p == "" or p[0].isspace() or p[-1].isspace() for p in parts), bool, len(parts))
        plain = np.fromiter((p.isascii() for p in parts), bool, len(parts))
        out[alone] = [self.after(parts[i]) for i in np.flatnonzero(alone)]
        for which in (plain & ~alone, ~plain & ~alone):
            some = [parts[i] for i in np.flatnonzero(which)]
            if some:
                ids = np.array(self.ids(" " + " ".join(some)))
                out[which] = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        return out

    def totals(self, texts: list[str], sums: np.ndarray) -> np.ndarray:
        """Ids of whole texts, from the sums of ``counts`` over what single spaces part them into.

        A text in which white space or the end follows a space is encoded whole.
        """
        out = sums.astype(np.int64)
        for i, t in enumerate(texts):
            if RUN.search(t):
                out[i] = len(self.ids(t))
            else:
                first = t.split(" ", 1)[0]
                out[i] += len(self.ids(first)) - self.after(first)
        return out

    def after(self, part: str) -> int:
        return len(self.ids(" " + part))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.ids(text), "<u4").tobytes() for text in texts]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)
