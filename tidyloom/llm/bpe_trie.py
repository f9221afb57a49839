"""BPE encoding by a trie of distinct words.

Whether a list of tokens is the BPE encoding of a string can be told from adjacent tokens alone: it is, if each pair of
neighbours is what their joined text encodes to.  So the encoding of a string is given by the last token of each of its
prefixes.  Distinct words go into a trie; a depth-first walk finds the last token of each node once, from the states of
the nodes above it, however many words share the prefix.  The encoding of a word is then read backwards from its end.

The library's normalizer and pre-tokenizer cut texts into words; merges and encoding are done here.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidyloom.llm.common import id_and_text
from tidyloom.llm.words import WordTable, distinct, parts_of

#: Words kept per Python worker before the cache starts anew; it bounds memory, not results.
CACHED_WORDS = 300_000
#: Longer words walk the same states without nodes of their own in the trie.
TRIE_DEPTH = 200

_SIMPLE = re.compile("[!-&(-/:-~]+")  # ASCII without apostrophes and digits: letters and the rest alternate
_RUNS = re.compile("[a-z]+|[^a-z]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class TrieBpe:
    """Encoder and decoder of a ``tokenizers`` file whose model is BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # A token that its own text does not encode to never occurs in an encoding.
        self.tokens = {t: i for t, i in self.vocab.items() if self._merge(self._symbols(t)) == [t]}
        self.longest = max(map(len, self.tokens))
        self.piece = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.piece[i] = t
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}  # by white-space chunk
        self.pieces: dict[str, bytes] = {}  # by word of the pre-tokenizer

    def _symbols(self, token: str) -> list[str]:
        end = self.suffix if self.suffix and token.endswith(self.suffix) and token != self.suffix else ""
        body = token[: len(token) - len(end)]
        return [*body[:-1], body[-1] + end]

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE, for the short texts of one or two tokens."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _pair(self, left: str, right: str) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > CACHED_WORDS:
                self.fits.clear()
            found = self.fits[left, right] = self._merge([*left, *self._symbols(right)]) == [left, right]
        return found

    def _last(self, text: str, depth: int, end: str, states: list[str]) -> str:
        """The last token of the encoding of ``text[:depth] + end``; ``states`` has that of each shorter prefix."""
        for start in range(max(0, depth - self.longest), depth):
            token = text[start:depth] + end
            if token in self.tokens and (not start or self._pair(states[start], token)):
                return token
        raise ValueError(f"no token ends {text[:depth]!r}")

    def _read(self, text: str, last: str, states: list[str]) -> list[int]:
        ids, depth = [self.tokens[last]], len(text) - (len(last) - len(self.suffix))
        while depth > 0:
            ids.append(self.tokens[states[depth]])
            depth -= len(states[depth])
        return ids[::-1]

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        root: dict = {}
        found: dict[str, list[int]] = {}
        for word in words:
            if len(word) > TRIE_DEPTH:
                states = [""]
                for d in range(1, len(word)):
                    states.append(self._last(word, d, "", states))
                found[word] = self._read(word, self._last(word, len(word), self.suffix, states), states)
                continue
            node = root
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(word)  # words that end one character below
        tokens, fits, longest = self.tokens, self.fits, self.longest
        states: list[str] = [""]
        stack = [("", 0, root)]
        while stack:
            path, depth, node = stack.pop()
            if depth:
                del states[depth:]
                # Exactly one token fits, so the likeliest may be tried first: the last one, grown by a character.
                token = states[-1] + path[-1]
                start = depth - len(token)
                if token not in tokens or start and not fits.get((states[start], token)):
                    for start in range(depth - longest if depth > longest else 0, depth):
                        token = path[start:]
                        if token in tokens and (not start or self._pair(states[start], token)):
                            break
                    else:
                        raise ValueError(f"no token ends {path!r}")
                states.append(token)
            for key, below in node.items():
                if key == "":
                    for word in below:
                        found[word] = self._read(word, self._last(word, depth + 1, self.suffix, states), states)
                else:
                    stack.append((path + key, depth + 1, below))
        return found

    def _odd_chunks(self, text: str) -> list[str]:
        """Chunks of a text with special tokens, or with characters that only Python takes for white space."""
        parts = self.special_split.split(text) if self.special_split else [text]
        return [c for part in parts for c in ([part] if part in self.special else _SPACE.split(part)) if c]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them without special tokens of its own."""
        for cache in (self.words, self.pieces):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        odd = {i: self._odd_chunks(t) for i, t in enumerate(texts) if "<|" in t or _ODD_SPACE.search(t)}
        lists = pc.utf8_split_whitespace(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string()))
        chunks, numbers, offsets = distinct(lists)
        self.words[""] = b""  # it never goes to the library, which would make one of the spaces around it
        new = [c for c in {*chunks, *(c for cs in odd.values() for c in cs)} if c not in self.words]
        for c in self.special:
            self.words[c] = struct.pack("<I", self.special[c])
        cut = self._cut([c for c in new if c not in self.special])
        ids = self.encode_words({p for _, ps in cut for p in ps if p not in self.pieces})
        self.pieces.update((p, struct.pack(f"<{len(i)}I", *i)) for p, i in ids.items())
        for c, ps in cut:
            self.words[c] = b"".join(map(self.pieces.__getitem__, ps))
        get = self.words.__getitem__
        out = WordTable(list(map(get, chunks))).texts(numbers, offsets)
        for i, cs in odd.items():
            out[i] = np.frombuffer(b"".join(map(get, cs)), "<u4")
        return out

    def _cut(self, chunks: list[str]) -> list[tuple[str, list[str]]]:
        """The words of each chunk; those of other than simple ones by one library call, which drops the spaces."""
        simple = [c for c in chunks if _SIMPLE.fullmatch(c)]
        out = [(c, _RUNS.findall(c.lower())) for c in simple]
        if len(simple) == len(chunks):
            return out
        return out + self._library_cut(list(set(chunks).difference(simple)))

    def _library_cut(self, chunks: list[str]) -> list[tuple[str, list[str]]]:
        """`_cut` by the library; ``chunks`` are not empty and hold no white space, so each space ends one."""
        text = self.library.normalizer.normalize_str(" ".join(chunks))
        out: list[tuple[str, list[str]]] = [(c, []) for c in chunks]
        ends = np.cumsum([len(c) + 1 for c in text.split(" ")])
        cuts = self.library.pre_tokenizer.pre_tokenize_str(text)
        of = np.searchsorted(ends, [at for _, (at, _) in cuts], "right")
        for (word, _), k in zip(cuts, of.tolist()):
            out[k][1].append(word)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` returns for a file that names no decoder."""
        return " ".join(map(self.piece.__getitem__, ids.tolist()))


_encoders: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """One encoder per Python worker."""
    if path not in _encoders:
        gc.disable()  # tries and caches have no cycles, and scanning them takes a fifth of the time
        _encoders[path] = TrieBpe(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<long>, decoded`` of every row.

    Null texts count as empty: no ids, empty decoded text.  Null ids and repeated rows stay as they are, extra columns
    are left out, an empty table gives an empty one.  Texts of any length are encoded whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part, texts in (p for b in batches for p in parts_of(b)):
            ids = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([i.astype("i8") for i in ids], pa.list_(pa.int64())),
                 pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: `encode`, hashed where it is made, so ids need not be moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part, texts in (p for b in batches for p in parts_of(b)):
            ids = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                 pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
