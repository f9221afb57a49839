"""The corpus operators against brute force, the libraries they stand in for, and odd input."""

import bisect
import gzip
import hashlib
import io
import math
import random
import zlib
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_oracle import connect, difference
from tidyloom.llm import (bpe_trie, hamming_search, html_extract, merkle, packing, pii, queries, simhash, suffix_dedup,
                          toxicity, warc)
from tidyloom.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [(5, "a" * 300), (3, "a" * 120), (None, "x" * 49 + "y" * 60), (7, "x" * 49 + "y" * 60), (7, "x" * 49 + "y" * 60),
       (9, None), (10, ""), (11, "ab" * 500), (12, "z" + "ab" * 400), (1, "é" * 100), (2, "è" + "é" * 99),
       (None, None), (20, "\0" * 200), (21, "\0" * 100 + "\x01" * 100), (22, "a  b \n c\n\n d <|endoftext|> e ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, n int, shard int")


# -- fingerprints

def test_no_text_is_a_single_leaf(spark):
    """An edit of the second half leaves the first recognizable, whatever marks a text has or lacks."""
    rng = random.Random(6)
    some = lambda n: ["".join(rng.choice("bcdfghklm") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    texts = ["! ".join(some(900)), "? ".join(some(800)), " ".join(some(700)), "".join(some(900)), "日".join(some(500)),
             "".join(some(80))[:200], ", ".join(some(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert min(r.near_edited for r in merkle.edited(docs).collect()) > 0.1
    long = spark.read.parquet(f"{SF}/documents.parquet").where("char_length(text) >= 200")
    assert merkle.edited(long).where("near_edited < 0.1").count() == 0


def test_differing_branches_name_the_changed_paragraph(spark):
    lines = [f"This is line {i} of a text that has some words in it and goes on for a while." for i in range(40)]
    other = [*lines]
    other[17] = other[17].replace("some words", "other things")
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    trees = rows.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"), F.col("b").alias("text"))
    (found,) = trees.select(merkle.differing(F.col("a"), F.col("b")).alias("ab"), merkle.differing(F.col("b"), F.col("a")).alias("ba"),
                            merkle.differing(F.col("a"), F.col("a")).alias("aa")).collect()
    assert found.aa == [] and {x.section for x in found.ab} == {x.section for x in found.ba} == {17}
    import re
    cuts = re.findall(merkle.PARAGRAPH, other[17])
    assert [x.paragraph for x in found.ba] == [i for i, c in enumerate(cuts) if c not in re.findall(merkle.PARAGRAPH, lines[17])]
    assert any("other things" in cuts[x.paragraph] or "other" in cuts[x.paragraph] for x in found.ba)


# -- personal data

def test_measures_and_scores_are_no_phone_numbers(spark):
    texts = ["grew +12 34 56 here, +5 1234 up", "call +44 20 7946 0958 now", "+999 12 345 678", "odds +210 55 66 77 88",
             "+49 (30) 1234 5678", "+1-415-555-0132"]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, _found int, _new string")
    got = {r.doc_id: r for r in pii.pseudonymize(rows).collect()}
    assert [got[i].n_found for i in range(6)] == [0, 1, 0, 0, 1, 1]
    assert all((got[i].text == t) == (got[i].n_found == 0) for i, t in enumerate(texts))
    assert got[1].text.startswith("call +44 ") and got[4].text.startswith("+49 (") and got[0]["_found"] == 1 and got[0]["_new"] == "x"


# -- pages

@pytest.mark.parametrize("source, texts", [
    ("<p title=it's>One long paragraph</p><p>Second</p>", ["One long paragraph", "Second"]),
    ("<p title=it's>text's more</p><p>b</p>", ["text's more", "b"]),
    ('<p title=5">inch</p><p>b"c</p>', ["inch", 'b"c']),
    ('<p class="a"" id=b>stray</p><p>"quoted"</p>', ["stray", '"quoted"']),
    ("<p title = \"a > b\" alt='<p>'>in quotes</p>", ["in quotes"]),
    ("<p title='never closed>a</p><p>b</p>", ["a", "b"]),
    ("<p 'x'>a</p><p \"y>z\">b</p>", ["a", 'z">b']),
    ("<p title==\"x\" a=b=c>a</p><a href=x'y>l</a>", ["a", "l"]),
])
def test_quotes_in_tags(source, texts):
    assert html_extract.Page(source).texts() == texts


# -- suffix arrays

def brute_repeats(rows):
    rows = [(suffix_dedup.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in sorted(rows):
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    out = []
    for d, b in rows:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                cover[i:i + 50] = True
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(cover.sum()), spans, bytes(x for x, c in zip(b, cover) if not c)))
    return sorted(out)


def found_repeats(df):
    return sorted((suffix_dedup.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                  for r in df.collect())


def test_repeats_match_brute_force(docs):
    got = suffix_dedup.remove_repeats(docs.repartition(3), chunk_bytes=60_000, shard_bytes=80_000, keep=("lang",))
    assert found_repeats(got) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_of_odd_rows(odd):
    assert found_repeats(suffix_dedup.remove_repeats(odd, chunk_bytes=300, shard_bytes=400)) == brute_repeats(ODD)
    assert suffix_dedup.remove_repeats(odd.limit(0)).collect() == []
    for r in suffix_dedup.remove_repeats(odd, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_two_stage_order_is_that_of_suffixes():
    rng = random.Random(3)
    text = "".join(rng.choices("ab", k=4000)).encode()
    wanted = np.zeros(len(text), bool)
    wanted[: len(text) - 50] = True
    order = suffix_dedup.sort_windows(np.frombuffer(text, "u1"), wanted)
    keys = [text[i:i + 50] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(text) - 50))


# -- packing

def test_pieces_and_places(docs, odd):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    for frame in (docs, odd):
        rows = packing.pack(frame, queries.BYTE_BPE, capacity=64, with_ids=True).collect()
        want = sorted([library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in frame.collect()])
        by_doc = {}
        for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
            assert r.length == len(r.ids) <= 64
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert r.piece == 0 or r.length == 64
            by_doc.setdefault(r.doc_id, []).append(r)
        assert sum(r.length for r in rows) == sum(map(len, want))
        if frame is docs:
            assert sorted([i for r in rs for i in r.ids] for rs in by_doc.values()) == want
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 64
    assert packing.pack(odd.limit(0), queries.BYTE_BPE).collect() == []


def test_plan_fills_gaps_exactly():
    assert packing.plan({700: 2, 324: 2}, 1024) == [((700, 324), 2)]
    assert packing.plan({500: 1, 300: 1, 224: 1}, 1024) == [((500, 300, 224), 1)]
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), 300)}
    plan = packing.plan(counts, 1024)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 1024
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    gaps = []  # best fit, the longest first, one by one
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        rest = (gaps.pop(at) if at < len(gaps) else 1024) - n
        bisect.insort(gaps, rest)
    assert sum(t for _, t in plan) <= 1.01 * len(gaps)


def test_sum_index_finds_what_brute_force_finds():
    rng = random.Random(5)
    for _ in range(30):
        left = {n: rng.randint(1, 3) for n in rng.sample(range(1, 60), 14)}
        index = packing.SumIndex(left, 100)
        for n in sorted(left, reverse=True):
            for size in (1, 2, 3):
                while left.get(n):
                    rest = index.exact(100 - n, n, size)
                    some = [g for g in combinations_with_replacement(sorted(left), size)
                            if sum(g) == 100 - n and index.has(n, *g)]
                    assert (rest is None) == (not some)
                    if rest is None:
                        break
                    assert tuple(sorted(rest)) in some
                    for x in (n, *rest):
                        left[x] -= 1
                        if not left[x]:
                            del left[x]


def test_exact_complements_beat_best_fit():
    rng = random.Random(9)
    counts = {}
    for _ in range(40_000):
        n = min(1024, 1 + int(rng.lognormvariate(5, 1)))
        counts[n] = counts.get(n, 0) + 1
    bound = -(-sum(n * c for n, c in counts.items()) // 1024)
    plans = [packing._plan(counts, 1024, most) for most in (0, 3)]
    alone, indexed = (sum(t for _, t in p) for p in plans)
    assert bound <= indexed <= min(alone, 1.001 * bound)
    assert {2, 3, 4} <= {len(p) for p, _ in plans[1] if sum(p) == 1024}


# -- pseudonyms

def test_pseudonyms_keep_format_and_links(spark):
    texts = ["4111111111111111 and 4111 1111 1111 1111", "Bob@x.example.com bob@x.example.com", "10.0.0.255 300.1.1.1",
             "2024-02-29 2023-02-29", "DE89 3704 0044 0532 0130 00 DE00370400440532013000", None, "",
             "plain 12345 text 3.14", "+1 (017) 555-7713", "123-45-6789 000-12-3456"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_found string")
    got = {r.doc_id: r for r in pii.pseudonymize(rows).collect()}
    a, b = got[0].text.split(" and ")
    digits = [int(c) for c in a]
    assert a == b.replace(" ", "") != "4111111111111111" and len(b.split()) == 4
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    first, second = got[1].text.split()
    assert first.lower() == second and first != "Bob@x.example.com" and first.endswith("@x.example.com")
    address, kept = got[2].text.split()
    assert kept == "300.1.1.1" and address != "10.0.0.255" and all(0 <= int(p) <= 255 for p in address.split("."))
    assert got[3].text.endswith(" 2023-02-29") and not got[3].text.startswith("2024-02-29")
    new = got[4].text[:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 and got[4].text.endswith(texts[4][27:])
    assert got[5].text is None and got[6].text == "" and got[7].text == texts[7]
    assert [got[i].n_found for i in range(10)] == [2, 2, 1, 1, 1, 0, 0, 0, 1, 1]
    assert got[9].text.endswith(" 000-12-3456")


def test_only_valid_card_numbers_change(spark):
    texts = ["4111111111111112 4111 1111 1111 1112", "in 2019 2020 2021 2022", "2019 2020 2021 2022 2023 2024 2025",
             "12 4111 1111 1111 1111 x", "2019 4111-1111-1111-1111 2020", "12345 2024-02-29", "4111111111111111 10.0.0.1",
             "4111 1111 1111 1111 5500 0000 0000 0004", "7 " * 5000 + "4111111111111111", "12345678901234567890"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(rows).collect()}
    assert [got[i].n_found for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 1, 0]
    assert [got[i].text for i in (0, 1, 2, 9)] == [texts[i] for i in (0, 1, 2, 9)]
    card = got[6].text.split()[0]
    assert card != "4111111111111111" and got[8].text == "7 " * 5000 + card
    assert got[3].text == f"12 {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} x"
    assert got[4].text == f"2019 {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]} 2020"
    assert got[5].text.startswith("12345 ") and got[5].text != texts[5] and not got[6].text.endswith(" 10.0.0.1")
    assert got[7].text.startswith(f"{card[:4]} {card[4:8]} ") and not got[7].text.endswith(" 0004")


def test_account_numbers_end_where_they_end(spark):
    account = "ES91 2100 0418 4502 0005 1332"
    texts = [account, f"{account} I said", "ES9121000418450200051332 EUR 50", f"{account} 4111 1111 1111 1111",
             "AT61 1904 3002 3457 3201 AND 2020", "BE68 5390 0754 7034 OK", f"{account[:-1]}3 I said",
             "NO93 8601 1117 947 A", "MR1300020001010000123456753 X"]
    texts += [f"ZZ{98 - int('1234567890123535' + '00') % 97:02} 1234 5678 9012 THE END"]  # no such country
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(rows).collect()}
    assert [got[i].n_found for i in range(10)] == [1, 1, 1, 2, 1, 1, 0, 1, 1, 1]
    new = got[0].text
    assert new != account and got[1].text == f"{new} I said" and got[2].text == new.replace(" ", "") + " EUR 50"
    assert got[3].text.startswith(f"{new} ") and not got[3].text.endswith("4111 1111 1111 1111")
    assert got[6].text == texts[6]
    for i, end in ((4, " AND 2020"), (5, " OK"), (7, " A"), (8, " X"), (9, " THE END")):
        assert got[i].text.endswith(end) and got[i].text != texts[i]
        plain = got[i].text.removesuffix(end).replace(" ", "")
        assert len(plain) == len(texts[i].removesuffix(end).replace(" ", ""))
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_feistel_permutes(spark):
    pairs = spark.range(12 * 7).select(pii.feistel_numbers(F.col("id") % 12, F.col("id") / 12, 12, 7, "k", "t").alias("p"))
    assert pairs.distinct().count() == 84 and pairs.where("p.l >= 12 OR p.r >= 7 OR p.l < 0 OR p.r < 0").count() == 0
    texts = spark.range(1000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("t"))
    assert texts.distinct().count() == 1000 and texts.where("NOT t RLIKE '^[0-9]{3}$'").count() == 0


# -- archives

def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b\r\n", "é" * 40_000), (1, None, "x"), (2, "u", "x"), (4, "u", None), (5, "u", ""), (5, "u", ""),
            (None, "u", "x"), (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in warc.round_trip(pages, segment_bytes=1000).collect()}
    assert got[3].payload_bytes == 80_000 and got[3].problem is None
    assert got[3].payload_digest == warc.digest(("é" * 40_000).encode())
    assert [got[i].record_type for i in (1, 2, None, 3, 4, 5, 6)] == [
        "response", "revisit", "revisit", "response", "response", "revisit", "response"]
    assert [got[i].refers_to for i in (2, None, 5, 1)] == [1, 1, 4, None] and got[2].payload_bytes == 1
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_keep_every_row(spark):
    big = "z" * 5000
    rows = [(5, "u", ""), (5, "u", ""), (5, "v", ""), (None, "u", "x"), (None, "u", "x"), (7, "u", big), (7, "u", big),
            (8, "u", big), (None, "u", "y"), (None, "u", "y"), (9, "u", "x"), (9, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages, segment_bytes=1000).select(
        "page_id", "payload_bytes", "record_type", "refers_to", "problem").collect()), key=str)
    assert len(got) == len(rows) == pages.count()
    assert got == sorted([(5, 0, "response", None, None)] * 3 + [(None, 1, "revisit", 9, None)] * 2
                         + [(7, 5000, "response", None, None)] * 2 + [(8, 5000, "revisit", 7, None)]
                         + [(None, 1, "response", None, None)] * 2 + [(9, 1, "response", None, None)] * 2, key=str)


def test_segments_across_archives_and_broken_ones(spark, tmp_path):
    payload = bytes(range(256)) * 20
    parts = warc.records(1, "u", payload, None, 500)
    broken = warc.records(2, "u", payload + b"2", None, 500)
    short = warc.records(3, "u", payload + b"3", None, 500)
    short[-1] = short[-1].replace(b"Total-Length: ", b"Total-Length: 9")
    for i, records in enumerate((parts[::2], parts[1::2], [*broken[:1], *broken[2:]], short)):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(b"".join(reversed(records))))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert bytes(got[1].payload) == payload and got[1].problem is None
    assert got[2].payload is None and "not all" in got[2].problem
    assert got[3].payload is None and "announced" in got[3].problem
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(parts[0][:-50])))


# -- fingerprints

def test_trees_locate_edits(spark):
    a, b = "One. Two.\nThree. Four.", "One. Two.\nThree. Fire."
    rows = {r.doc_id: r for r in merkle.edited(spark.createDataFrame(
        [(1, a, "z"), (2, b, "z"), (3, a, "z"), (3, a, "z"), (None, None, "z"), (4, "", "z")],
        "doc_id long, text string, h string")).collect()}
    assert rows[1].fingerprint == rows[3].fingerprint != rows[2].fingerprint
    assert rows[1].fingerprint.split("|")[1].split(";")[0] == rows[2].fingerprint.split("|")[1].split(";")[0]
    # Short lines are one paragraph each; each counts its length and one: the first of two lines is shared.
    assert rows[3].near_next == pytest.approx(10 / 23) and rows[4].near_next == 0
    assert rows[3].edited == a[:11] + b[:11] and rows[None].edited == "" and rows[1].edited == a[:11]
    assert merkle.edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- search

def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 400).astype("i8")
    codes[:100] = codes[0] ^ (1 << rng.integers(0, 6, 100))
    codes[100:160] = codes[0]
    rows = spark.createDataFrame([(int(i), int(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    got = {}
    for r in hamming_search.top_k(rows, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    assert len(got) == 20
    for q, found in got.items():
        d = np.bitwise_count(codes.view("u8") ^ codes.view("u8")[q])
        assert [(d_, i) for _, d_, i in sorted(found)] == sorted((int(x), i) for i, x in enumerate(d))[:7]
    assert hamming_search.top_k(rows.limit(0), F.lit(True)).collect() == []
    assert len(hamming_search.top_k(rows.limit(3), F.lit(True)).collect()) == 9


def test_search_of_many_queries_in_few_chunks(spark, monkeypatch):
    """A chunk of several slices, of which the last is short, gives what single queries give."""
    monkeypatch.setattr(hamming_search, "QUERIES_PER_SLICE", 7)
    monkeypatch.setattr(hamming_search, "CODES_PER_BLOCK", 150)
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 62, 300) & 0x3FF
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    found = {(r.query_id, r.rank): (r.vec_id, r.distance) for r in hamming_search.top_k(rows, F.lit(True), 3).collect()}
    for q, code in enumerate(codes):
        order = sorted((int(int(code) ^ int(c)).bit_count(), i) for i, c in enumerate(codes))[:3]
        assert [found[q, n] for n in (1, 2, 3)] == [(i, d) for d, i in order]
    assert len(found) == 900


def test_sign_codes(spark):
    rows = spark.createDataFrame([(1, [1.0, -1.0, 0.5]), (2, None), (None, [1.0]), (3, []), (4, [None, 2.0])],
                                 "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hamming_search.sign_codes(rows).collect())) == [(1, 5), (3, 0), (4, 2)]


# -- fingerprints

def test_made_pages_are_extracted():
    model, rng = html_extract.learn(300), random.Random(123)
    right = wrong = missed = 0
    for source in (html_extract._made_page(rng) for _ in range(150)):
        got = html_extract.extract([source], model)[0].split()
        want = sum(w[0] == "m" for t in html_extract.Page(source).texts() for w in t.split())
        main = sum(w[0] == "m" for w in got)
        right, wrong, missed = right + main, wrong + len(got) - main, missed + want - main
    assert right / (right + wrong) > 0.99 and right / (right + missed) > 0.98


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<p>a &amp;\n b<p>c &#233;</article></p> <b"),
             (3, "u", "<div " + "x" * 10_000 + "<ul><li>1<li>2")]
    rows = html_extract.main_text(spark.createDataFrame([(*p, 0) for p in pages],
                                                        "page_id long, url string, html string, text int")).collect()
    assert len(rows) == 5 and all(r.n_chars == len(r.text) for r in rows)


def test_no_remainder_of_a_page_is_cut():
    def text(source):
        return " ".join(" ".join(html_extract.Page(source).texts()).split())

    assert text("<p>a</p><svg viewBox='0'/><p>b</p><p>c") == "a b c"
    assert text("<p>a <svg><title>t</title><path d='x'/><text>n</text></svg> b</p>") == "a b"
    for tag in ("button", "select", "object", "video", "audio", "canvas", "noscript", "template", "svg"):
        assert text(f"<div><{tag}>x</div><p>a</p><p>b</p><div><{tag}>y</{tag}></div>c").endswith("a b c")
        assert text(f"<p>a</p><{tag}>x<div>y</div></{tag}><p>b</p>") == "a b"
        assert text(f"<p>a</p><{tag}><p>b</p>") == "a b"
    assert text("<p>a<noscript><div>x</div><a href=y>z</a></noscript>b</p>") == "ab"
    assert text("<object>x<object>y</object>z</object>a") == "a"
    assert text("<html><head><title>x</title><p>text") == "text"
    assert text("<html><head><title>x</title><meta a=b><noscript><img src=x>n</noscript>text <b>c</b>") == "text c"
    assert text("<html><head><title>x</title> <span>a</span></head><body>b") == "a b"


# -- toxicity

def test_fit_matches_ftrl_of_single_coordinates():
    """The update rule written out for one coordinate at a time, over texts of few words."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("vile nasty kind calm day sun rain".split()) for _ in range(rng.randint(0, 6)))
             for _ in range(120)]
    labels = [int("vile" in t or "nasty" in t) for t in texts]
    z, n, rate = {}, {}, sum(labels) / len(labels)
    bias, bias_n = math.log(rate / (1 - rate)), 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / (
            (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    examples = [sorted(set(toxicity.features([t])[0].tolist())) for t in texts]
    for _ in range(toxicity.EPOCHS):
        for found, y in zip(examples, labels):
            w = {i: weight(i) for i in found}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in found:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.02 * g / (1 + math.sqrt(bias_n))
    got, got_bias = toxicity.fit(toxicity.present(texts), np.array(labels, float))
    assert got_bias == pytest.approx(bias)
    assert {int(i) for i in np.flatnonzero(got)} == {i for i in z if weight(i)}
    assert any(weight(i) for i in z)
    for i in z:
        assert got[i] == pytest.approx(weight(i))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_toxicity_ftrl(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_scores_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights, bias = toxicity.learn(odd, none)
    rows = toxicity.score(odd, weights, bias, keep=("text", "n")).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (3, None), (10, 0)], "doc_id long, toxic int")
    toxicity.learn(odd, some)


# -- BPE

def test_trie_encodes_as_the_library(docs, odd):
    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = [r.text or "" for r in [*docs.collect(), *odd.collect()]] + [
        "A<|endoftext|>b <|startoftext|>", "É́ İΣΑΣ ß'S don't 12ab３", "\x1c a\x1fb\x85c d", "日本語 🙂🙂", "a" * 1000]
    coder = bpe_trie.encoder(queries.WORD_BPE)
    for text, ids in zip(texts, coder.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)
    rows = bpe_trie.encode(odd, queries.WORD_BPE).collect()
    assert len(rows) == len(ODD) and all(r.ids == [] for r in rows if r.doc_id in (9, 10))


def test_trie_keeps_chunks_apart_however_they_are_hashed():
    """An empty chunk among those cut by the library would shift the words of all behind it."""
    library, coder = Tokenizer.from_file(queries.WORD_BPE), bpe_trie.TrieBpe(queries.WORD_BPE)
    rnd = random.Random(5)
    for n in range(60):
        coder.words.clear()
        texts = [" ".join(f"é{rnd.getrandbits(20):x}" for _ in range(n + 1)), "", " ß  3 "]
        for text, ids in zip(texts, coder.encode_batch(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder._library_cut(["é1", "ß"]) == [("é1", ["Ã©", "1"]), ("ß", ["ÃŁ"])]


# -- SimHash

def brute_components(codes, ids, bits):
    root = list(range(len(codes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1") <= bits:
                root[top(i)] = top(j)
    least = {}
    for i in range(len(codes)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(codes))]


def test_near_duplicates_match_brute_force(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert [r.component_id for r in rows] == brute_components([r.code for r in rows], [r.doc_id for r in rows], 4)


def test_vantage_trees_lose_no_link():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 3000).astype("u8")
    codes[1500:] = codes[:1500] ^ np.bitwise_or.reduce(
        np.uint64(1) << rng.integers(0, 64, (1500, 4)).astype("u8"), axis=1)
    forest = simhash.Forest(len(codes))
    everyone = np.arange(len(codes))
    block, simhash.BLOCK = simhash.BLOCK, 1 << 12
    for keys in simhash.halves(codes):
        simhash.join_codes(codes, keys, everyone, everyone, 4, forest)
    simhash.BLOCK = block
    assert (forest.root[1500:] == forest.root[:1500]).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 91)], "a long, b long")
    found = dict(components(edges).collect())
    assert found == {i: 0 for i in range(1, 41)} | {91: 90}


def test_fingerprints_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.code == 0} == {9}
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


# -- pipeline

def test_first_rows_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(2, "a b c d e", 7, 8), (1, "a b c d e", 9, 10), (None, "x", 11, 12)],
                                 "doc_id long, text string, _row int, _ROW_ int")
    kept = simhash.first_rows(rows)
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e", 9, 10), (None, "x", 11, 12)]


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name in ("suffix_array", "pii"):
            assert after.count() == docs.count()
        docs = after
    assert corpus_pipeline.run(spark, SF).groupBy("doc_id").count().count() == docs.count()


def test_pipeline_of_odd_rows(spark, odd):
    docs = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
    digest = hashlib.sha256(b"").hexdigest()
    assert digest and public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_keeps_one_row_of_a_group(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "blue", "green"))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (7, b), (9, None), (None, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, c), (9, "")], key=str)


ODD_TABLES = {
    "pages": "VALUES (NULL, 'u', 'x'), (9, 'u', 'x'), (NULL, 'u', 'y'), (NULL, 'v', 'y'), (4, NULL, NULL), (5, 'u', ''), "
             "(6, 'u', 'z'), (6, 'u', 'z'), (7, 'u', 'z')",
    "documents": "VALUES (2, 'one. two! three'), (2, 'one. two! three'), (1, 'first'), (NULL, 'none'), (NULL, NULL), (3, ''), "
                 "(1, 'other of one'), (4, repeat('word here ', 300)), (5, repeat('bcd', 200)), (6, 'a' || chr(10) || chr(10))",
}


@pytest.mark.parametrize("name, table, columns", [
    ("op4_warc_segments", "pages", "page_id, url, html"), ("op5_merkle_fingerprints", "documents", "doc_id, text")])
def test_query_matches_sql_on_odd_rows(spark, tmp_path, name, table, columns):
    """Null and repeated ids, repeated rows and equal payloads have one result in the operator and its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS SELECT CAST(column0 AS BIGINT) AS column0, * EXCLUDE (column0) FROM ({ODD_TABLES[table]}) t("
                + ", ".join(f"column{i}" for i in range(len(columns.split(",")))) + ")")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM t AS t({columns})")
    con.execute(f"COPY (SELECT * FROM {table}) TO '{tmp_path}/{table}.parquet'")
    assert difference(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name]) is None


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None
