"""Token ids by a public tokenizer file, inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Bytes that other white space begins with; texts that have them are looked at one by one.
_OTHER = np.zeros(256, bool)
_OTHER[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_JOINED = re.compile(f"[ \n]{_WIDE}|{_WIDE}[ \n]")
#: Parts remembered per worker in each of two generations, and the longest part worth it.
_REMEMBER, _LONGEST = 500_000, 64
#: Texts and bytes encoded at a time, and new parts at a time.
STEP, STEP_BYTES, PIECES = 1024, 3_000_000, 2000


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Byte-level tokenizers start a new piece at every single space or line end between two other
    characters, whatever stands before it, so a text is the sum of its parts cut there, and a part
    that was seen before need not be encoded again. Parts not seen yet are encoded many at a time as
    one text; the tokens that begin with the space or line end tell where each of them starts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that begin with their only white space."""
        raw = self._ids([b"".join(parts).decode()])[0]
        cuts = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, "<u4")])).tolist()
        if len(cuts) != len(parts):
            raise ValueError("the tokenizer does not start pieces at spaces")
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    def _values(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > _REMEMBER:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, parts))
        missing = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(missing, map(self.older.get, [parts[i] for i in missing]), strict=True):
            out[i] = v
        new = [i for i in missing if out[i] is None]
        # Parts with white space elsewhere, and what texts begin with, are encoded one by one.
        alone = [i for i in new if parts[i][0] in b" \n" and parts[i][1:].split() == [parts[i][1:]]]
        for at in range(0, len(alone), PIECES):
            some = alone[at:at + PIECES]
            for i, v in zip(some, self._learn([parts[i] for i in some]), strict=True):
                out[i] = v
        other = [i for i in new if out[i] is None]
        for i, v in zip(other, self._ids([parts[i].decode() for i in other]), strict=True):
            out[i] = v
        self.known.update((parts[i], out[i]) for i in missing if len(parts[i]) <= _LONGEST)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        joined = b"".join(raws)
        data, first = np.frombuffer(joined, np.uint8), np.append(0, np.cumsum([len(r) for r in raws], dtype=np.int64))
        n = len(data)
        of = lambda at: np.searchsorted(first, at, side="right") - 1
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        space = _SPACES[data]
        lone = (data == 0x20) | (data == 0x0A)
        lone[1:] &= ~space[:-1] | edge[1:n]
        lone[:-1] &= ~space[1:] | edge[1:n]
        for i in np.unique(of(np.flatnonzero(_OTHER[data]))).tolist():
            if _JOINED.search(texts[i]):
                lone[first[i]:first[i + 1]] = False
        starts = np.flatnonzero(lone | edge[:n])
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, n).astype(np.int32)), pa.py_buffer(joined)
        ]).dictionary_encode()
        which = parts.indices.to_numpy()
        values = self._values(parts.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], np.int64)
        source, count = np.append(0, size.cumsum())[:-1][which], size[which]
        place = np.append(0, count.cumsum())
        body = flat[np.repeat(source - place[:-1], count) + np.arange(place[-1])].tobytes()
        cuts = (4 * place[np.searchsorted(starts, first)]).tolist()
        return [body[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def encoded(path: str, texts: list[str | None], end: int = 0) -> Iterator[bytes]:
    """The ids of each text and the end id; null counts as empty."""
    tail = np.asarray([end], "<u4").tobytes()
    work = encoder(path)
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if len(held) == STEP or size > STEP_BYTES:
            yield from (ids + tail for ids in work.encode(held))
            held, size = [], 0
    if held:
        yield from (ids + tail for ids in work.encode(held))
