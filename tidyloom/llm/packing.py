"""Best-fit packing of tokenized documents into sequences of fixed length, by exact complements.

Only lengths matter for the plan, and there are at most ``capacity`` of them.  So the plan is made from the histogram of
piece lengths, a bounded table: an index of the sums of one, two and three lengths gives what fills each kind of gap
exactly, as often as the counts allow; what has no exact complement is packed best-fit.  The plan is a list of patterns, each with the
number of sequences it is used for.  Pieces of one length are numbered, and the number decides pattern, sequence and
place: no piece is ever moved to a common task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidyloom.llm.common import id_and_text, written
from tidyloom.llm.words import WordTable, distinct, parts_of

CACHED_CHUNKS = 300_000
PIECES_PER_BUCKET = 50_000

#: Fixed value: how byte-level pre-tokenizers cut words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_RUN = re.compile(r"\s ")


class ChunkTokens:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file, computed per distinct chunk.

    The pre-tokenizer starts a token at each space that follows another character, so a text may be cut at its spaces,
    and each distinct chunk is encoded once, by tiktoken over the vocabulary of the same file; the tests hold it against
    the library.  Texts where white space precedes a space go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.size = np.zeros(max([*ranks.values(), *special.values()]) + 1, "i8")
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.size[i] = len(t)
        self.coder = tiktoken.Encoding("chunks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.chunks: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all")

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks, which all begin with a space; those without other white space in one call."""
        plain = [c for c in chunks if len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        if plain:
            ids = self._encode("".join(plain))
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(c.encode()) for c in plain])) + 1
            raw, at = ids.astype("<u4").tobytes(), 0
            for c, end in zip(plain, (4 * ends).tolist()):
                self.chunks[c] = raw[at:end]
                at = end
        for c in set(chunks).difference(plain):
            self.chunks[c] = self._encode(c).astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        odd = [i for i, t in enumerate(texts) if _RUN.search(t)]
        plain = pa.array(["" if _RUN.search(t) else t for t in texts] if odd else texts, pa.string())
        words, numbers, offsets = distinct(pc.split_pattern(plain, " "))
        first = offsets[:-1]
        openings, of_first = np.unique(numbers[first], return_inverse=True)
        numbers = numbers.copy()
        numbers[first] = len(words) + of_first
        inner = [" " + w for w in words]
        self._learn([c for c in inner if c not in self.chunks])
        table = WordTable([self.chunks[c] for c in inner]
                          + [self._encode(words[k]).astype("<u4").tobytes() for k in openings.tolist()])
        out = table.texts(numbers, offsets)
        for i, e in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        return out


def _byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable Latin-1 is itself, the rest follows
    from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


_tokenizers: dict[str, ChunkTokens] = {}


def _tokens(path: str) -> ChunkTokens:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokens(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: documents above ``capacity`` are cut into pieces of it, of which the first may be shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokens(path), np.array([end_id], "<u4")
        for part, texts in (p for b in batches for p in parts_of(b)):
            rows: list[tuple] = []
            for doc_id, body in zip(part.column("doc_id").to_pylist(), tokens.encode_batch(texts)):
                ids = np.concatenate([body, end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    piece = ids[a:b]
                    row = (doc_id, k, a, b - a, zlib.crc32(piece.tobytes()))
                    rows.append((*row, piece.tolist()) if with_ids else row)
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())]
                       + [("ids", pa.list_(pa.int64()))] * with_ids)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


class SumIndex:
    """Lengths of which pieces are left, by the sums of one, two and three of them; ``left`` is consumed by the caller.

    A pair is filed under its sum by its shorter length, so pairs of sums up to ``capacity`` are at most its square by
    four.  A triple is its shortest length and a pair from the index; the triples of a sum are listed as they are asked
    for.  Combinations whose shortest length is largest come first, since short pieces fill later gaps.  Counts only
    fall, so what is used up is passed once.
    """

    def __init__(self, left: dict[int, int], capacity: int):
        self.left, self.lengths = left, sorted(left)
        self.shorter: dict[int, array] = {}
        for i, b in enumerate(self.lengths):
            for a in self.lengths[i:bisect.bisect_right(self.lengths, capacity - b)]:
                self.shorter.setdefault(a + b, array("i")).append(b)
        self.triples: dict[int, Iterator[tuple[int, int, int]]] = {}
        self.next_triple: dict[int, tuple[int, int, int] | None] = {}

    def has(self, *group: int) -> bool:
        return all(self.left.get(n, 0) >= group.count(n) for n in group)

    def exact(self, gap: int, n: int, size: int) -> tuple[int, ...] | None:
        """``size`` lengths that fill the gap beside ``n`` exactly and of which pieces are left, else None."""
        if size == 1:
            return (gap,) if self.has(n, gap) else None
        found = self.pairs(gap) if size == 2 else self.remaining_triples(gap)
        return next((group for group in found if self.has(n, *group)), None)

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        filed = self.shorter.get(total, array("i"))
        while filed and not self.has(total - filed[-1], filed[-1]):
            filed.pop()
        for k in range(len(filed) - 1, -1, -1):
            if k < len(filed) and self.has(total - filed[k], filed[k]):  # others may have shortened it meanwhile
                yield total - filed[k], filed[k]

    def _triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        for c in reversed(self.lengths[:bisect.bisect_right(self.lengths, total // 3)]):
            if c in self.left:
                yield from ((a, b, c) for a, b in takewhile(lambda pair: pair[1] >= c, self.pairs(total - c)))

    def remaining_triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """The triple found last as long as it can be had, then those after it."""
        if total not in self.triples:
            self.triples[total] = self._triples(total)
            self.next_triple[total] = next(self.triples[total], None)
        while (group := self.next_triple[total]) is not None:
            if self.has(*group):
                yield group
            self.next_triple[total] = next(self.triples[total], None)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences each is used for; each available length is used exactly as often.

    Exact complements of three pieces can use up short pieces that best fit needs, where there are few pieces.  So the
    plans with complements of up to three, two, one and no pieces are made, and the shortest is taken.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in counts.items() if c > 0}
    index = SumIndex(left, capacity if most > 1 else 0)
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        times = min(left[n] // pattern.count(n) for n in pattern)
        patterns.append((pattern, times))
        for n in set(pattern):
            left[n] -= pattern.count(n) * times
            if not left[n]:
                del left[n]

    if capacity in left:
        use((capacity,))
    # All gaps are offered single pieces before any is offered pairs, and pairs before triples.
    for size in range(1, most + 1):
        for n in sorted(left, reverse=True):
            while left.get(n) and (rest := index.exact(capacity - n, n, size)):
                use((n, *rest))
    # Residuals: the longest first, then as long as anything fits, whatever leaves the smallest gap.
    lengths = sorted(left)
    while lengths:
        pattern, gap = (lengths[-1],), capacity - lengths[-1]
        while True:
            at = bisect.bisect_right(lengths, gap) - 1
            while at >= 0 and not index.has(*pattern, lengths[at]):
                at -= 1
            if at < 0:
                break
            pattern, gap = (*pattern, lengths[at]), gap - lengths[at]
        use(pattern)
        lengths = [n for n in lengths if n in left]
    return patterns


def place(numbered: DataFrame, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """Sequence and offset from ``length`` and ``rank``, the number of a piece among those of its length."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}  # of a length: first rank, times, first sequence, offset
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            ranges.setdefault(n, []).append((used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    tables = {n: np.array(rows, "i8").T for n, rows in ranges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence_id, offset = np.empty(len(rank), "i8"), np.empty(len(rank), "i8")
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                first, _, base, at = tables[n]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence_id[mine], offset[mine] = base[k] + rank[mine] - first[k], at[k]
            out = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(sequence_id), pa.array(offset)], [*out.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every document; one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``, so a null or empty text is one piece of length 1.  Null ids, repeated ids and
    repeated rows are documents of their own; extra columns are left out; an empty table gives an empty one.  With
    ``with_ids`` the pieces carry their ids.
    """
    cut = pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # Buckets bound the group in which pieces of one length are numbered; equal pieces of equal ids are spread too.
    buckets = max(1, -(-cut.count() // PIECES_PER_BUCKET))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("length", "bucket", (
        F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "row")
    numbered = cut.withColumn("_k", F.row_number().over(order)).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        (F.col("before") + F.col("_k") - 1).alias("rank"))
    return place(numbered, plan(histogram, capacity))
