"""Texts as numbers of distinct words: what is done to a word is then done once for all its occurrences in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at a time, or one text if that is longer.
CHARS_PER_PART = 3_000_000


def parts_of(batch: pa.RecordBatch, chars: int = CHARS_PER_PART) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about so many characters in their ``text``, and these texts."""
    at, taken, texts = 0, 0, []
    for row, value in enumerate(batch.column("text")):
        texts.append(value.as_py())
        taken += len(texts[-1])
        if taken >= chars or row == batch.num_rows - 1:
            yield batch.slice(at, row + 1 - at), texts
            at, taken, texts = row + 1, 0, []


def distinct(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of lists, for each word of all lists its number among them, and where each list begins."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), offsets.astype("i8") - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``lengths[0]`` numbers, then the same of each next run."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, "i8")
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class WordTable:
    """Ids of distinct words as one flat array, to look up all occurrences of a batch at once."""

    def __init__(self, encoded: list[bytes]):
        self.flat = np.frombuffer(b"".join(encoded), "<u4")
        self.lengths = np.fromiter(map(len, encoded), "i8", len(encoded)) // 4
        self.starts = np.cumsum(self.lengths) - self.lengths

    def texts(self, words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, whose words are ``words[offsets[i]:offsets[i + 1]]``."""
        lengths = self.lengths[words]
        ids = self.flat[spread(self.starts[words], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
