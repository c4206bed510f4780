"""Token ids of whole texts with the ``tokenizers`` library, inside Spark tasks.

Word-level vocabularies encode every whitespace-separated piece on its own, so pieces that were
seen before come from a bounded table of the worker, and new ones go to the library many in one
text, with a mark between them; other vocabularies encode whole texts.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

_PROBES = ("a", "Foo,", "don't", "7x", "été.", "x..", "(B)", "it's!")
_TAILS = frozenset(b".,;:!?")
_MARK = b"|"
#: New pieces in one text.
_TOGETHER = 5000


class Encoder:
    """Encodes texts to ids, each as the bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._keep = keep
        self._known: dict[bytes, bytes] = {}
        self._special = [t.content.lower().encode() for t in self._model.get_added_tokens_decoder().values()]
        # spaces add nothing, case adds nothing, and a closing mark is a token of its own
        apart = [p.lower() for p in _PROBES]
        whole = self._ids([" ".join(_PROBES) + "\n\tb"])[0]
        self._by_word = whole == b"".join(self._ids([*apart, "b"])) and self._ids(["foo,"])[0] == b"".join(self._ids(["foo", ","]))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self._model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _apart(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: pieces in one text lie between the places of the mark's id."""
        mark, together = self._ids([_MARK.decode()])[0], [p for p in pieces if _MARK not in p]
        known: dict[bytes, bytes] = {}
        for at in range(0, len(together), _TOGETHER):
            part = together[at : at + _TOGETHER]
            ids = self._ids([(b" %b " % _MARK).join(part).decode()])[0]
            cuts = [4 * int(k) for k in np.flatnonzero(np.frombuffer(ids, "<u4") == np.frombuffer(mark, "<u4")[0])]
            # a piece that has the mark's id itself leaves its whole part to be encoded one by one
            if len(mark) == 4 and len(cuts) == len(part) - 1:
                known.update(zip(part, (ids[lo:hi] for lo, hi in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)]))))
        alone = [p for p in pieces if p not in known]
        known.update(zip(alone, self._ids([p.decode() for p in alone])))
        return [known[p] for p in pieces]

    def _learn(self, pieces: set[bytes]) -> None:
        stems = {p: p[:-1] if len(p) > 1 and p[-1] in _TAILS and 97 <= p[-2] <= 122 else p for p in pieces}
        new = {s for s in stems.values()} | {p[-1:] for p, s in stems.items() if s is not p}
        new = [s for s in new if s not in self._known]
        self._known.update(zip(new, self._apart(new)))
        for p, s in stems.items():
            if s is not p:
                self._known[p] = self._known[s] + self._known[p[-1:]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            return self._ids(texts)
        out: list = [None] * len(texts)
        get, fresh, holes, odd = self._known.get, set(), [], []
        for k, text in enumerate(texts):
            # bytes.lower() and bytes.split() know ASCII only; the tokenizer does the rest
            low = text.encode().lower()
            if any(s in low for s in self._special):
                odd.append(k)
                continue
            words = low.split()
            ids = list(map(get, words))
            if None in ids:
                new = [i for i, x in enumerate(ids) if x is None]
                fresh.update(words[i] for i in new)
                holes.append((k, words, ids, new))
            else:
                out[k] = b"".join(ids)
        before = len(self._known)
        self._learn(fresh)
        for k, words, ids, new in holes:
            for i in new:
                ids[i] = self._known[words[i]]
            out[k] = b"".join(ids)
        for k, ids in zip(odd, self._ids([texts[k] for k in odd])):
            out[k] = ids
        if len(self._known) > self._keep:
            # the first pieces seen are the common ones: keep those, forget this batch's
            while len(self._known) > before:
                self._known.popitem()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    return Encoder(path)
