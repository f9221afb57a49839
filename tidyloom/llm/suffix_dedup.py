"""Removal of byte strings that repeat across documents, by suffix arrays over shards of the corpus.

A string of ``WINDOW`` bytes is assigned to a shard by its minimizer, the smallest hash of the ``GRAM``-byte strings in
it, so equal strings meet in one shard.  Neighbouring windows mostly share their minimizer and travel as one snippet.

1. Documents are written as chunks.  Each chunk tells every shard the distinct minimizers it has, four bytes each; a
   shard answers with those that another chunk has too.  Only windows of such minimizers, or of those that occur twice
   in the chunk, can repeat.
2. Their snippets go to the shards, equal ones once per chunk, with the smallest id of their documents.  A shard sorts
   the windows by a two-stage suffix array: only suffixes smaller than their successors are sorted directly, the others
   are induced by scanning the buckets of first bytes.  Adjacent common prefixes of at least ``WINDOW`` bytes make
   groups of equal windows, and a window is marked if its group has a smaller id than the snippet it is in.
3. Each chunk unites its marks and cuts its documents.

A string in a third of all documents is one entry per chunk in its shard, whatever the documents in the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import shards, ship, written
from tidyloom.llm.words import spread

WINDOW, GRAM = 50, 16
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
_BLOCK = 1 << 17
_PAD = 64
#: Ids that are null: larger than any other.
NO_ID = np.iinfo("i8").max

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(padded: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on as a number; ``padded`` ends with at least eight more bytes."""
    return np.ndarray((len(padded) - 8,), dtype, buffer=padded.data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def minimizer_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run of windows with one minimizer; ``ends`` are of documents."""
    lengths = np.diff(ends, prepend=0)
    short = np.minimum(lengths, WINDOW - 1)
    valid = np.ones(len(data), bool)
    valid[spread(ends - short, short)] = False  # windows that would reach into the next document
    padded = np.concatenate([data, np.zeros(_PAD, "u1")])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(data) - WINDOW + 1), _BLOCK):
        size = min(_BLOCK, len(data) - WINDOW + 1 - at)
        w = _words(padded[at:at + size + WINDOW + 8]).copy()
        low = _mix(w[:size + WINDOW - GRAM] * _A + w[8:size + WINDOW - GRAM + 8] * _B)
        for step in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-step], low[step:])
        rest = WINDOW - GRAM + 1 - 32
        low = np.minimum(low[:-rest], low[rest:])[:size]
        ok = valid[at:at + size]
        first = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (ok[1:] != ok[:-1])) + 1])
        count = np.diff(first, append=size)
        keep = ok[first]
        found.append((first[keep] + at, count[keep], _mix(low[first[keep]] * _A)))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    return tuple(np.concatenate(x) for x in zip(*found))


def _shard(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype("i4")


def _present(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards that occur, of an ascending array, and where each begins, with the end of the last; a chunk costs what
    it holds, however many shards there are."""
    some, first = np.unique(shard, return_index=True)
    return some, np.append(first, len(shard))


def _sort_directly(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in the order of their next WINDOW bytes, refined by eight bytes at a time where they tie."""
    key = words[at].astype("u8")
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    opens = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for k in range(8, WINDOW, 8):
        tied = np.flatnonzero(~opens | ~np.append(opens[1:], True))
        if not len(tied):
            break
        group = np.cumsum(opens[tied])
        key = words[at[tied] + k].astype("u8")
        if WINDOW - k < 8:
            key >>= np.uint64(8 * (8 - (WINDOW - k)))
        order = np.lexsort((key, group))
        at[tied] = at[tied][order]
        key = key[order]
        opens[tied[1:]] |= key[1:] != key[:-1]
    return at


def sort_windows(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions in suffix order, as far as WINDOW bytes tell, by two-stage sorting."""
    size = len(text) + 2
    t = np.concatenate([text, np.array([0, 1], "u1"), np.zeros(_PAD, "u1")])
    words = _words(t, ">u8")
    differs = np.append(t[:size - 1] != t[1:size], True)
    # A suffix compares with its successor as the next two bytes that differ do.
    turn = np.flatnonzero(differs)
    smaller = np.repeat(t[turn] < t[turn + 1], np.diff(turn, prepend=-1))
    smaller[-1] = False
    needed = np.zeros(size, bool)
    needed[:len(text)] = wanted
    # A suffix that is induced needs its successors, up to one that is sorted directly.
    at = np.flatnonzero(needed & ~smaller) + 1
    while len(at):
        at = at[~needed[at]]
        needed[at] = True
        at = at[~smaller[at]] + 1
    direct = _sort_directly(words, np.flatnonzero(needed & smaller))
    edges = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Deal the predecessors of scanned suffixes to their buckets; those of this bucket come back."""
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        first = t[before]
        same = before[first == byte]
        before, first = before[first != byte], first[first != byte]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[t[part[0]]].append(part)
        return same

    for byte in range(256):
        scan = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, "i8")
        while len(scan):
            scan = induce(scan, byte)
        if edges[byte] < edges[byte + 1]:
            induce(direct[edges[byte]:edges[byte + 1]], byte)
    order = np.concatenate(out) if out else np.zeros(0, "i8")
    order = order[order < len(text)]
    return order[wanted[order]]


def repeated_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window of the snippets, in order, whether an equal one has a smaller id."""
    windows = spread(starts, counts)
    number = np.full(len(text), -1, "i4")  # of the window that starts at a position
    number[windows] = np.arange(len(windows))
    order = sort_windows(text, number >= 0)
    words = _words(np.concatenate([text, np.zeros(_PAD, "u1")]), ">u8")
    same = np.arange(1, len(order))
    for k in range(0, WINDOW, 8):  # adjacent common prefixes, as far as they matter
        a, b = words[order[same - 1] + k].astype("u8"), words[order[same] + k].astype("u8")
        if WINDOW - k < 8:
            a, b = (x >> np.uint64(8 * (8 - (WINDOW - k))) for x in (a, b))
        same = same[a == b]
    opens = np.ones(len(order), bool)
    opens[same] = False
    of = np.repeat(np.arange(len(ids), dtype="i4"), counts)  # the snippet of a window
    order = number[order]
    marks = np.zeros(len(windows), bool)
    first = np.flatnonzero(opens)
    if len(first):
        found = ids[of[order]]
        least = np.repeat(np.minimum.reduceat(found, first), np.diff(first, append=len(order)))
        marks[order] = least < found
    return marks


def _chunks(docs: DataFrame, keep: list[str], chunk_bytes: int) -> DataFrame:
    """``chunk, ids, ends, data, rest``: documents side by side; ``rest`` has the other columns to keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            texts = table.column("text").cast(pa.large_binary()).combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset:][:len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]]
            ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
            sink = pa.BufferOutputStream()
            rest = table.drop_columns(["text"])
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rest)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in ((number, pa.int64()), (ids.astype("<i8").tobytes(), pa.binary()),
                 ((offsets[1:] - offsets[0]).astype("<i8").tobytes(), pa.binary()),
                 (packer.compress(data.tobytes()), pa.binary()), (sink.getvalue().to_pybytes(), pa.binary()))],
                ["chunk", "ids", "ends", "data", "rest"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            total, at = size + np.cumsum(lengths), 0
            while at < batch.num_rows:
                until = min(batch.num_rows, int(np.searchsorted(total, chunk_bytes)) + 1)
                held.append(batch.slice(at, until - at))
                size = int(total[until - 1])
                if size >= chunk_bytes:
                    yield row()
                    number, held, total, size = number + 1, [], total - size, 0
                at = until
        if held:
            yield row()

    names = ["doc_id", "text", *keep]
    return docs.select(*names).mapInArrow(run, "chunk long, ids binary, ends binary, data binary, rest binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(row["data"])
    return np.frombuffer(data, "u1"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return ({n: batch.column(n)[i].as_py() for n in batch.schema.names}
            for batch in batches for i in range(batch.num_rows))


def _tell_keys(chunks: DataFrame, count: int) -> DataFrame:
    """``shard, chunk, keys``: the distinct keys of each chunk, four bytes of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, _, ends = _open(row)
            keys = np.unique(minimizer_runs(data, ends)[2])
            some, edges = _present(_shard(keys, count))
            low = keys.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), row["chunk"])),
                 pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                ["shard", "chunk", "keys"])

    return chunks.select("chunk", "ids", "ends", "data").mapInArrow(run, "shard int, chunk long, keys binary")


def _shared_keys(group: pa.Table) -> pa.Table:
    """Of each chunk's keys those that another one has."""
    rows = [np.frombuffer(k, "<u4") for k in group.column("keys").to_pylist()]
    values = np.concatenate(rows)
    ordered = np.sort(values)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    # One look-up for all chunks together: one for each would go through the shared keys as often as there are chunks.
    found = np.append(shared, 0)[np.searchsorted(shared, values)] == values
    found &= values <= (shared[-1] if len(shared) else -1)
    edges = np.cumsum([0, *map(len, rows)])
    mine = [values[a:b][found[a:b]].tobytes() for a, b in zip(edges, edges[1:])]
    table = pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"),
                      "keys": pa.array(mine, pa.binary())})
    return table.filter(pa.compute.greater(pa.compute.binary_length(table.column("keys")), 0))


class Candidates:
    """What may repeat of a chunk: runs of windows, numbered by equal snippets in the order of shards.

    ``row`` is a chunk with what the shards told it.  Both steps that need this compute it, which is cheaper than to
    store it.
    """

    def __init__(self, row: dict, count: int):
        self.data, self.ids, self.ends = _open(row)
        starts, counts, keys = minimizer_runs(self.data, self.ends)
        shard = _shard(keys, count)
        place = shard.astype("u8") << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))
        ordered = np.sort(place)
        shared = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *(
            np.uint64(x["shard"]) << np.uint64(32) | np.frombuffer(x["keys"], "<u4").astype("u8")
            for x in row["told"] or [])])
        chosen = np.flatnonzero(np.isin(place, shared))
        chosen = chosen[np.argsort(shard[chosen], kind="stable")]
        self.starts, self.counts = starts[chosen], counts[chosen]
        raw, known = self.data.tobytes(), {}
        self.number = np.fromiter((known.setdefault(raw[a:a + c + WINDOW - 1], len(known)) for a, c in zip(
            self.starts.tolist(), self.counts.tolist())), "i8", len(chosen))
        self.snippets = list(known)
        self.doc = self.ids[np.searchsorted(self.ends, self.starts, "right")]
        self.least = np.full(len(known), NO_ID)  # smallest id of a snippet in this chunk
        np.minimum.at(self.least, self.number, self.doc)
        self.shard = np.zeros(len(known), "i4")
        self.shard[self.number] = shard[chosen]


def _snippets(chunks: DataFrame, count: int) -> DataFrame:
    """Of each chunk, a row for each shard its snippets go to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for row in _rows(batches):
            c = Candidates(row, count)
            some, edges = _present(c.shard)
            lengths = np.fromiter(map(len, c.snippets), "<i8", len(c.snippets))
            blobs = [packer.compress(b"".join([lengths[a:b].tobytes(), c.least[a:b].astype("<i8").tobytes(),
                                               *c.snippets[a:b]])) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), row["chunk"])),
                 pa.array(np.diff(edges)), pa.array(blobs, pa.binary())],
                ["shard", "chunk", "snippets", "state"])

    return chunks.mapInArrow(run, "shard int, chunk long, snippets long, state binary")


def _mark(group: pa.Table) -> pa.Table:
    """Per chunk, a bit for each window of its snippets in the shard: whether a smaller id has it."""
    opener = zstandard.ZstdDecompressor()
    texts, lengths, ids, sizes = [], [], [], group.column("snippets").to_pylist()
    for blob, size in zip(group.column("state"), sizes):
        raw = opener.decompress(blob.as_py())
        lengths.append(np.frombuffer(raw, "<i8", size))
        ids.append(np.frombuffer(raw, "<i8", size, 8 * size))
        texts.append(np.frombuffer(raw, "u1", offset=16 * size))
    length = np.concatenate(lengths)
    counts = length - (WINDOW - 1)
    marks = repeated_windows(np.concatenate(texts), np.cumsum(length) - length, counts, np.concatenate(ids))
    windows = [int((n - (WINDOW - 1)).sum()) for n in lengths]
    parts = np.split(marks, np.cumsum(windows)[:-1])
    table = pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "windows": pa.array(windows),
                      "marks": pa.array([np.packbits(p).tobytes() if p.any() else None for p in parts], pa.binary())})
    return table.filter(pa.compute.is_valid(table.column("marks")))


OUT = "n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_ends array<long>, kept binary"


def _cut(chunks: DataFrame, keep_schema: str, count: int, whole_characters: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Candidates(row, count)
            data, ends = c.data, c.ends
            # The marks of snippets in order; shards that have none to tell leave theirs unset.
            per_snippet = np.zeros(len(c.least), "i8")
            per_snippet[c.number] = c.counts
            base = np.cumsum(per_snippet) - per_snippet
            marks = np.zeros(per_snippet.sum(), bool)
            for x in row["marked"] or []:
                first = base[np.searchsorted(c.shard, x["shard"])]
                marks[first:first + x["windows"]] = np.unpackbits(np.frombuffer(x["marks"], "u1"), count=x["windows"])
            repeated = np.repeat(c.doc > c.least[c.number], c.counts) | marks[spread(base[c.number], c.counts)]
            opens = np.zeros(len(data) + 1, "i4")
            opens[spread(c.starts, c.counts)[repeated]] = 1
            total = np.concatenate([np.zeros(WINDOW, "i4"), np.cumsum(opens[:-1], dtype="i4")])
            covered = total[WINDOW:] > total[:-WINDOW]
            if whole_characters and len(data):
                first = np.flatnonzero((data & 0xC0) != 0x80)
                covered = np.repeat(np.logical_and.reduceat(covered, first), np.diff(first, append=len(data)))
            begin = np.concatenate([[0], ends[:-1]])
            turns = np.concatenate([covered[:1], covered[1:] != covered[:-1]])
            turns[begin[begin < len(data)]] = covered[begin[begin < len(data)]]
            span_starts = np.flatnonzero(turns & covered)
            stops = np.append(~covered[1:], True) if len(data) else covered
            stops[ends[ends > 0] - 1] = True
            span_ends = np.flatnonzero(covered & stops) + 1
            removed = np.concatenate([np.zeros(1, "i4"), np.cumsum(covered, dtype="i4")])
            edge = np.concatenate([[0], ends])
            in_doc = np.searchsorted(span_starts, edge)
            of = np.repeat(begin, np.diff(in_doc))
            kept = data[~covered].tobytes()
            at = (edge - removed[edge]).tolist()
            rest = pa.ipc.open_stream(row["rest"]).read_all()
            lists = [pa.ListArray.from_arrays(in_doc.astype("i4"), pa.array(x - of))
                     for x in (span_starts, span_ends)]
            out = pa.table([*rest.columns, pa.array(np.diff(edge)), pa.array(np.diff(removed[edge]).astype("i8")),
                            pa.array(np.diff(in_doc)), *lists,
                            pa.array([kept[a:b] for a, b in zip(at, at[1:])], pa.binary())],
                           [*rest.schema.names, "n_bytes", "n_removed", "n_spans", "span_starts", "span_ends", "kept"])
            yield from out.to_batches(max_chunksize=2000)

    return chunks.mapInArrow(run, f"{keep_schema}, {OUT}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   whole_characters: bool = False, chunk_bytes: int = CHUNK_BYTES,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte that lies in a string of ``WINDOW`` bytes that also starts in a document with a smaller id.

    Returns ``doc_id``, the columns named in ``keep``, ``n_bytes, n_removed, n_spans, span_starts, span_ends, kept``
    (bytes) of every row; offsets are in bytes of the document.  Null texts count as empty.  A null id is larger than
    any other; rows with one id, null included, remove nothing from each other.  With ``whole_characters`` a character
    goes only if all its bytes do, so ``kept`` stays valid UTF-8.  Other columns are left out; an empty table gives an
    empty one.
    """
    ship(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    keep_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema if f.name != "text")
    count = shards(clean, F.octet_length("text"), shard_bytes)
    chunks = written(_chunks(clean, list(keep), chunk_bytes), "chunks")
    told = _tell_keys(chunks, count).groupBy("shard").applyInArrow(_shared_keys, "chunk long, shard int, keys binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("shard", "keys")).alias("told"))
    chunks = chunks.join(told, "chunk", "left")
    marked = _snippets(chunks, count).groupBy("shard").applyInArrow(
        _mark, "chunk long, shard int, windows long, marks binary")
    marked = marked.groupBy("chunk").agg(F.collect_list(F.struct("shard", "windows", "marks")).alias("marked"))
    return _cut(chunks.join(marked, "chunk", "left"), keep_schema, count, whole_characters)
