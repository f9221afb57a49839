"""Benchmark passages in documents, found by one Aho-Corasick automaton over words.

A window is a run of consecutive words of a test item.  All windows of all items form one trie; failure links make it
an automaton that reads each document once, word by word, however many windows there are.  Texts are normalised to
words before, and each word keeps its place in the original text, so what is found is reported as spans of the
original.  Words that occur in no window can only take the automaton back to its root, so the walk is done on the runs
of known words alone, found for a whole batch at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import written
from tidyloom.llm.terms import cut, id_and_bytes, parts_of, words_in_sql

WINDOW = 10
#: Most windows in one automaton (some 150 bytes per word of a window in each Python worker); more take several passes.
WINDOWS_PER_AUTOMATON = 200_000

_FOUND = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<long>"


class Automaton:
    """Aho-Corasick over word numbers; ``lists[i]`` names the items of window ``i``."""

    def __init__(self, windows: Iterable[bytes], lists: list[list[int]]):
        number: dict[bytes, int] = {}
        paths = [[number.setdefault(w, len(number)) for w in window.split(b" ")] for window in windows]
        self.vocabulary = pa.array(list(number), pa.binary())
        self.width = max(1, len(number))
        self.least = min(map(len, paths), default=0)
        self.next: dict[int, int] = {}  # node * width + word -> node; node 0 is the root
        depth, self.ends = [0], [-1]
        children: list[list[int]] = [[]]
        for window, path in enumerate(paths):
            node = 0
            for word in path:
                key = node * self.width + word
                node = self.next.get(key, -1)
                if node < 0:
                    node = self.next[key] = len(depth)
                    children[key // self.width].append(word)
                    children.append([])
                    depth.append(depth[key // self.width] + 1)
                    self.ends.append(-1)
            self.ends[node] = window
        self.depth, self.lists = depth, lists
        # The failure link of a node is the longest proper suffix that is a node; `shorter` is the nearest window
        # among the suffixes, since windows of short items can end inside longer ones.
        self.fail, self.shorter = [0] * len(depth), [0] * len(depth)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for word in children[node]:
                child = self.next[node * self.width + word]
                if node:
                    self.fail[child] = self._step(self.fail[node], word)
                link = self.fail[child]
                self.shorter[child] = link if self.ends[link] >= 0 else self.shorter[link]
                queue.append(child)

    def _step(self, node: int, word: int) -> int:
        while True:
            found = self.next.get(node * self.width + word)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.fail[node]

    def scan(self, words: list[int]) -> tuple[list[int], list[int], set[int]]:
        """Where each occurrence begins and ends among ``words``, and which windows occur."""
        follow, width, fail, ends, shorter = self.next.get, self.width, self.fail, self.ends, self.shorter
        starts, stops, windows, node = [], [], set(), 0
        for at, word in enumerate(words):
            found = follow(node * width + word)
            while found is None and node:
                node = fail[node]
                found = follow(node * width + word)
            node = found or 0
            out = node if ends[node] >= 0 else shorter[node]
            if out:
                starts.append(at + 1 - self.depth[out])  # the longest one covers what the shorter ones do
                stops.append(at + 1)
                while out:
                    windows.add(ends[out])
                    out = shorter[out]
        return starts, stops, windows


_automata: dict[str, Automaton] = {}


def _automaton(name: str, shared: Broadcast) -> Automaton:
    """The automaton of a broadcast, built once per Python worker; only the last one is kept."""
    if name not in _automata:
        _automata.clear()
        _automata[name] = Automaton(*shared.value)
    return _automata[name]


def _known_runs(known: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` known words within one text."""
    first, last = known.copy(), known.copy()
    first[1:] &= ~known[:-1]
    last[:-1] &= ~known[1:]
    inner = before[(before > 0) & (before < len(known))]
    first[inner] = known[inner]
    last[inner - 1] = known[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long_enough = ends - starts >= least
    return starts[long_enough], ends[long_enough]


def _scan(part: pa.RecordBatch, automaton: Automaton) -> pa.RecordBatch:
    texts = part.column("text")
    found = cut(texts)
    coded = found.words.dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, automaton.vocabulary), -1).to_numpy(zero_copy_only=False)
    words = number[coded.indices.to_numpy()] if len(found.starts) else np.zeros(0, "i4")
    change = np.zeros(len(words) + 1, "i8")
    items: dict[int, set[int]] = {}
    runs = _known_runs(words >= 0, found.before, automaton.least) if automaton.least else ([], [])
    for a, b in zip(*runs):
        starts, stops, windows = automaton.scan(words[a:b].tolist())
        if windows:
            np.add.at(change, a + np.array(starts), 1)
            np.add.at(change, a + np.array(stops), -1)
            doc = int(np.searchsorted(found.before, a, "right")) - 1
            items.setdefault(doc, set()).update(i for w in windows for i in automaton.lists[w])
    hit = np.cumsum(change)[:-1] > 0
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[found.before])
    spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
    for doc in items:
        spans[doc] = _spans(texts[doc].as_py(), found, doc, hit, int(_first_byte(texts, doc)))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(found.before), pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array([sorted(items.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.int64()))],
        ["doc_id", "n_words", "n_hit", "spans", "items"])


def _first_byte(texts: pa.Array, row: int) -> int:
    return pc.sum(pc.binary_length(texts.slice(0, row))).as_py() or 0


def _spans(text: bytes, found, doc: int, hit: np.ndarray, base: int) -> list[dict]:
    """Runs of hit words of one text, from the first to past the last character, in characters of the original."""
    a, b = found.before[doc], found.before[doc + 1]
    edge = np.diff(np.concatenate([[0], hit[a:b].astype("i1"), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)])
    return [{"start": int(s), "end": int(e)} for s, e in
            zip(chars[found.starts[a:b][first] - base], chars[found.ends[a:b][last] - base])]


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window, item_id``: each run of ``size`` words of each item, or all its words if it has fewer but any.

    A window that several items share has a row for each.  Rows that share an id are one item.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts_of(b, size=BYTES_OF_ITEMS)):
            rows = set()
            for item, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                words = cut(pa.array([text.as_py()], pa.binary())).words.to_pylist()
                for at in range(max(len(words) - size + 1, 1) if words else 0):
                    rows.add((b" ".join(words[at:at + size]), item))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()),
                                              pa.array([i for _, i in rows], pa.int64())], ["window", "item_id"])

    return id_and_bytes(items, id_col, text_col).mapInArrow(run, "window binary, item_id long").distinct()


BYTES_OF_ITEMS = 1 << 20


def _pass(docs: DataFrame, found: DataFrame, keep: str = "") -> DataFrame:
    """Documents scanned for the windows of one automaton, which is all that comes to the driver."""
    lists: dict[bytes, list[int]] = {}
    for window, item in found.toLocalIterator():
        lists.setdefault(bytes(window), []).extend([] if item is None else [item])
    name, shared = uuid4().hex, docs.sparkSession.sparkContext.broadcast((list(lists), list(lists.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared)
        for part in (p for b in batches for p in parts_of(b)):
            out = _scan(part, automaton)
            for column in part.schema.names[2:]:
                out = out.append_column(column, part.column(column))
            yield out

    return docs.mapInArrow(run, _FOUND + keep)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", per_automaton: int = WINDOWS_PER_AUTOMATON,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``spans`` are the runs of these words as characters of
    the original text (end exclusive), ``items`` the ids of the items with an occurring window, each once, ascending.

    Null and empty texts have no words; an item without words has no window.  An item without id marks words, but has
    no id to list.  Null ids, ties and repeated rows of documents stay as they are; columns other than id and text are
    left out, so their names cannot clash.  An empty table of documents gives an empty one, one of items finds nothing.

    With more windows than one automaton holds, each share of them is a pass of its own over rows numbered in a written
    table, and what the passes find in a row is put together by its number.
    """
    found = written(windows(items, size, item_id_col, item_text_col), "windows")
    docs, passes = id_and_bytes(docs, id_col, text_col), max(1, -(-found.count() // per_automaton))
    if passes == 1:
        return _pass(docs, found)
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    share = F.pmod(F.xxhash64("window", "item_id"), F.lit(passes))
    hits = [written(_pass(docs, found.where(share == i), ", _row long").where("n_hit > 0").select("_row", "spans", "items"),
                    "hits") for i in range(passes)]
    both = hits[0]
    for more in hits[1:]:
        both = both.union(more)
    both = both.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts_of(b)):
            words = cut(part.column("text"))
            counts, spans = [], []
            for row, listed in enumerate(part.column("spans").to_pylist()):
                text, a, b = part.column("text")[row].as_py(), words.before[row], words.before[row + 1]
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)])
                base = _first_byte(part.column("text"), row) if listed else 0
                first, hit = chars[words.starts[a:b] - base] if listed else [], np.zeros(b - a, bool)
                for span in listed or []:
                    hit[slice(*np.searchsorted(first, [span["start"], span["end"]]))] = True
                counts.append(int(hit.sum()))
                spans.append(_spans(text, words, row, np.concatenate([np.zeros(a, bool), hit]), base) if listed else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(words.before), pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pc.fill_null(part.column("items"), pa.scalar([], pa.list_(pa.int64())))],
                ["doc_id", "n_words", "n_hit", "spans", "items"])

    joined = docs.join(both, "_row", "left").select("doc_id", "text", "spans", "items")
    return joined.mapInArrow(merge, _FOUND)


def without_passages(text: Column | str, spans: Column | str) -> Column:
    """The text without the spans found in it, which are replaced by one space each."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(kept, " ")


#: The same by joining all runs of as many words as some window has.
SQL = f"""
WITH i AS (SELECT item_id, {words_in_sql("text")} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
        SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1),
            lambda p: list_slice(ws, p, p + 9))) AS win FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
d AS (SELECT row_number() OVER () AS r, doc_id, {words_in_sql("text")} AS ws FROM documents),
runs AS (SELECT r, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win FROM (
        SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT r, runs.n, p, item_id FROM runs JOIN w ON runs.n = w.n AND runs.win = w.win),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
