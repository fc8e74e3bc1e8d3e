"""Words of many texts at once, as codes into a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split into words at a time (one text may be longer).
AT_ONCE = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(texts: list[str | None], at_once: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Row ranges of about at_once characters."""
    at = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= at_once or i == len(texts) - 1:
            yield at, i + 1
            at, total = i + 1, 0


def split_words(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts, one a line and more where they have line breaks, begins and ends of their words in it, text number of each word).
    ASCII letters are lower-cased, null is empty."""
    data = [(t or "").encode().lower() for t in texts]
    joined = b"\n".join([*data, b""])
    space = _SPACE[np.frombuffer(joined, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[True, space]))  # begin and end of each word, in turn
    ends = np.cumsum([len(x) + 1 for x in data])
    return joined, edge[::2], edge[1::2], np.searchsorted(ends, edge[::2], side="right")


def encode(joined: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(codes of the words, vocabulary)."""
    edge = np.column_stack([begins, ends]).ravel().astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(edge) - 1), [None, pa.py_buffer(edge), pa.py_buffer(joined)])
    coded = words.take(pa.array(np.arange(0, len(words), 2))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def coded_words(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes of all words in order, vocabulary, number of words of each text)."""
    joined, begins, ends, owner = split_words(texts)
    return *encode(joined, begins, ends), np.bincount(owner, minlength=len(texts))
