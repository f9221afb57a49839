"""Decontamination, the conversation trie and ranked search against brute force, with odd rows and small bounds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from check_oracle import connect, difference
from tidyloom.llm import decontaminate, lexical_search, prefix_trie, queries, terms

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@given(st.lists(st.text(alphabet="aZ09 é—\x00\x7f_-\n日", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_cut_as_by_the_pattern(texts):
    found = terms.cut(pa.array([t.encode() for t in texts], pa.binary()))
    flat = "".join(texts).encode()
    for i, t in enumerate(texts):
        mine = slice(found.before[i], found.before[i + 1])
        assert [w.decode() for w in found.words.to_pylist()[mine]] == words(t)
        assert [flat[a:b].decode().lower() for a, b in zip(found.starts[mine], found.ends[mine])] == [
            w.lower() for w in words(t)]


# -- decontamination

def brute_hits(text, items, size):
    ws = words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        iw = words(item_text)
        n = min(size, len(iw))
        grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(ws) - n + 1) if grams else ():
            if tuple(ws[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                ids |= {item}
    return len(ws), len(hit), sorted(i for i in ids if i is not None)


def _random_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ab", "é", "x1", "日本"]
    some = lambda n: rng.choice([" ", ", ", "\n\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.randint(1, 9))) for i in range(12)] + [(3, some(5)), (None, some(4)), (50, None), (51, "--")]
    docs = [(i, some(rng.randint(0, 40))) for i in range(40)] + [(None, None), (7, ""), (7, some(30)), (8, "?!")]
    return docs, items


@pytest.mark.parametrize("per_automaton", [1000, 7])
def test_contamination_is_what_brute_force_finds(spark, per_automaton):
    docs, items = _random_rows(1)
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n_hit int, spans string")
    found = decontaminate.contamination(df.repartition(3), spark.createDataFrame(items, "item_id long, text string"), 4,
                                        per_automaton=per_automaton).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in found) == sorted(
        (str(i), *brute_hits(t, items, 4)) for i, t in docs)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    for r in found:  # the spans of the original hold just the hit words
        assert any(sum(len(words(t[s.start:s.end])) for s in r.spans) == r.n_hit
                   and all(words(t[s.start]) and words(t[s.end - 1]) for s in r.spans) for t in texts[r.doc_id])


def test_passages_are_cut_by_their_spans(spark):
    docs = spark.createDataFrame([(1, "Clean é start. The ANSWER, is: forty-two! And more."), (2, "nothing")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(9, "the answer is forty two")], "item_id long, text string")
    spans = decontaminate.contamination(docs, items).select("doc_id", "spans", "items")
    out = docs.join(spans, "doc_id").select("doc_id", "items", decontaminate.without_passages("text", "spans").alias("t"))
    got = {r.doc_id: (list(r["items"]), r.t) for r in out.collect()}
    assert got == {1: ([9], "Clean é start.  ! And more."), 2: ([], "nothing")}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, none).collect()] == [(1, 2, 0, [], [])]
    assert decontaminate.contamination(docs.where("false"), none).count() == 0


def test_a_short_window_inside_a_long_one_counts():
    automaton = decontaminate.Automaton([b"a b c", b"b c", b"c"], [[1], [2], [3]])
    assert automaton.scan([0, 1, 2]) == ([0], [3], {0, 1, 2})


# -- conversation trie

def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - math.fmod(c, 100), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [k for k in members if k[:len(node)] == node]
        parents = {k[:-1] for k in members if k}
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(k) == len(node) + 1 for k in below), sum(k not in parents for k in below),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["hi", "héllo", "", None]))
            for c in [*range(100, 130), 200, 205, 299, 350, -3] for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "lost"), (205, None, "user", "first"), (400, 0, "u", "same"), (400, 0, "u", "same")]
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 560) for t in range(12)]  # a hot path
    rows += [(777, t, "user", f"long {t}") for t in range(90)]
    return rows


@pytest.mark.parametrize("band, per_shard", [(4096, 200_000), (2, 60), (1, 10)])
def test_trie_is_what_brute_force_builds(spark, band, per_shard):
    rows = _conversations(2)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, d1 string").repartition(5)
    found = prefix_trie.trie(df, band=band, per_shard=per_shard)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    (only,) = prefix_trie.trie(spark.createDataFrame([(7, 1, "u", "x")], schema)).where("depth = 0").collect()
    assert (only.conv_id, only.parent_conv_id, only.n_convs, only.n_leaves) == (7, None, 1, 1)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    first, second = rng.integers(0, 1 << 62, (2, 5000)).astype("u8")
    second[:2500] = second[2500:]  # halves may agree
    table = prefix_trie.SlotTable(first, second)
    assert sorted(table.slots(first, second)) == list(range(5000))
    assert (table.slots(first, second + np.uint64(1)) == -1).all()
    assert prefix_trie.SlotTable(first[:0], second[:0]).slots(first, second).max() == -1


def test_a_digest_collision_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 1, 1, 3, True), (2, 1, 5, 5, 0, 0, 2, 1, 3, True)],
                                 "conv long, depth long, d1 long, d2 long, p1 long, p2 long, x1 long, x2 long, size long, "
                                 "last boolean")
    with pytest.raises(Exception, match="share a digest"):
        prefix_trie._nodes(rows).collect()


# -- ranked search

def brute_ranking(docs, items, k):
    counted = [(d, Counter(words(t))) for d, t in docs]
    n = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                        * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        out += [(str(item), r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("per_search", [1 << 18, 10])
def test_search_is_what_brute_force_ranks(spark, per_search):
    docs, items = _random_rows(4)
    docs += [(900 + i, "x1 x1 é unique") for i in range(30)]  # ties of equal texts
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, key int").repartition(4)
    found = lexical_search.top_documents(df, spark.createDataFrame(items, "item_id long, text string"), 5,
                                         per_search=per_search)
    assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in found.collect()), key=str) == brute_ranking(
        docs, items, 5)


def test_search_of_real_tables_by_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    found = queries.QUERIES["op13_bit_sliced_search"](spark, SF).collect()
    assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in found), key=str) == brute_ranking(
        [(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 20)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "zz")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical_search.top_documents(docs, items).collect()] == [(1, 1, 1)]
    assert lexical_search.top_documents(docs.where("false"), items).count() == 0
    assert lexical_search.top_documents(docs, items.where("false")).count() == 0


def test_bounds_never_fall_below_scores():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    block, texts = lexical_search._Block(6), []
    hashes = lexical_search._hashes(vocabulary)
    for key in range(40):
        count = np.minimum(rng.geometric(0.3, 60), 40) * (rng.random(60) < 0.4)
        count[0] = 1
        at = np.flatnonzero(count)
        block.add(key, int(count.sum()), hashes[at], count[at])
        texts.append(count)
    items = lexical_search._collect_items([(1, b"w1 w2 w2 w9"), (2, b"w3 w50 nowhere")], {w: i for i, w in enumerate(vocabulary)})
    corpus = lexical_search.Corpus(40, int(np.sum(texts)), np.full(len(items.vocabulary), 700))
    every = np.append(hashes, lexical_search._hashes([b"nowhere"]))
    for lines, _, keys, bounds in lexical_search._bounds(block.row(), items, corpus, every):
        for line in lines:
            own = slice(items.starts[line], items.starts[line + 1])
            for d, key in enumerate(keys):
                count = np.append(texts[key], 0)[items.terms[own]]
                damping = corpus.damping(np.array([texts[key].sum()]))
                true = (items.repeats[own] * 700 * lexical_search.term_factor(count, damping)).sum()
                assert bounds[line, d] >= true


@pytest.mark.parametrize("name", ["op11_aho_corasick_decontamination", "op12_prefix_trie_slots", "op13_bit_sliced_search"])
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None
