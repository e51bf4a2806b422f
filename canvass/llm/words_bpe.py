"""Token ids by a word-wise tokenizer of the ``tokenizers`` library.

The tokenizer drops white space and never joins what stands on two sides of it, so
the words between ASCII white space are encoded by themselves and each one once:
a worker keeps the ids of the words that it has met, and gives the library the
others, many in one call.  Texts in Latin-1 are put in lower case first, which the
tokenizer would do (and nothing else would it normalise in them), so that capitals
make no other words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Words whose ids a worker keeps; when full, it starts anew.  Longer ones aren't kept.
KEEP, LONG = 1 << 20, 64
#: Words in one call, with a mark between them, and characters encoded at once.
JOINED, STRETCH = 200, 1 << 20
MARK = "\0"
WHITE = re.compile(r"[ \t-\r]+")
#: Python's white space that the tokenizer doesn't take for such.
NO_WHITE = "\x1c\x1d\x1e\x1f"


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that begin at white space."""
    low = 0
    while len(text) - low > STRETCH:
        cut = WHITE.search(text, low + STRETCH)
        if cut is None:
            break
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:] if low else text


class Encoder:
    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian unsigned 32-bit numbers."""
        out: dict[str, bytes] = {}
        short = []
        for w in words:
            if len(w) > LONG or MARK in w:
                out[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                short.append(w)
        groups = [short[i : i + JOINED] for i in range(0, len(short), JOINED)]
        joined = [f" {MARK} ".join(g) for g in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            data = ids.tobytes()
            for w, low, high in zip(group, (4 * cuts[:-1] + 4).tolist(), (4 * cuts[1:]).tolist(), strict=True):
                out[w] = data[low:high]
        return out

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [w for w in WHITE.split(text) if w]
        if "<|" in text:  # a special token is looked for before lower case
            return [w for w in WHITE.split(text) if w]
        text = text.lower()
        if any(c in text for c in NO_WHITE):
            return [w for w in WHITE.split(text) if w]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for stretch in stretches(text):
                waiting.append((k, self.split(stretch)))
                size += len(stretch)
                if size >= STRETCH:
                    self._flush(waiting, out)
                    size = 0
        self._flush(waiting, out)
        return [b"".join(x) for x in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known = self.known
        found = [list(map(known.get, words)) for _, words in waiting]
        new = {w for (_, words), ids in zip(waiting, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        learned = self._learn(new) if new else {}
        for (k, words), ids in zip(waiting, found, strict=True):
            if None in ids:
                ids = [learned[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            out[k].append(b"".join(ids))
        if len(known) + len(learned) > KEEP:
            known.clear()
        known.update((w, i) for w, i in learned.items() if len(w) <= LONG)
        waiting.clear()


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The worker's encoder of this tokenizer file's content."""
    key = hash(source)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source)
    return _encoders[key]
