"""Document fingerprints as Merkle trees, in column expressions only.

A text is a list of sections, its lines; a section is a list of paragraphs of at most 96 characters, since a line of prose
often holds a whole page.  A paragraph ends at the first place, 32 characters on or later, behind a sentence mark or a word
that ends in one of three vowels; the content alone decides, so the cuts fall into step again behind an edit.  Where there
is no such place it ends after 96 characters.  Hashes of paragraphs make those of sections, and these the root.  The cuts
lose nothing, so equal roots mean equal texts; `differing` walks two trees down the branches that differ to the
paragraphs that one of them lacks.

A fingerprint reads ``root|section:paragraph.length,paragraph.length;section:...``.  The root is whole, the other
hashes are shortened; they are still made from whole ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm.common import written

SECTION_HEX, PARAGRAPH_HEX = 16, 8
#: A paragraph; both Java and RE2 read it alike.
PARAGRAPH = r"[^\n]{32,94}?(?:[.!?] |[aeo] )|[^\n]{1,96}"


def fingerprint(text: Column) -> Column:
    """The tree of a text; null counts as empty."""
    hashes = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda section: F.transform(
            F.when(section == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(section, F.lit(PARAGRAPH), F.lit(0))),
            lambda p: F.struct(F.md5(p).alias("h"), F.char_length(p).alias("n"))))
    sections = F.transform(hashes, lambda ps: F.struct(
        F.md5(F.array_join(F.transform(ps, lambda p: p.h), ",")).alias("h"),
        F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p.h, 1, PARAGRAPH_HEX), F.lit("."),
                                                        p.n.cast("string"))), ",").alias("ps")))
    # A lambda over one element evaluates the tree once for both of its uses.
    return F.transform(F.array(sections), lambda tree: F.concat(
        F.sha2(F.array_join(F.transform(tree, lambda s: s.h), ";"), 256), F.lit("|"),
        F.array_join(F.transform(tree, lambda s: F.concat(F.substring(s.h, 1, SECTION_HEX), F.lit(":"), s.ps)), ";"))
    )[0]


def paragraphs(tree: Column) -> Column:
    """The distinct paragraphs of a fingerprint, as ``hash.length``."""
    return F.array_distinct(F.flatten(F.transform(
        F.split(F.substring_index(tree, "|", -1), ";", -1),
        lambda s: F.split(F.substring(s, SECTION_HEX + 2, 1 << 30), ",", -1))))


def differing(a: Column, b: Column) -> Column:
    """Where a text has what another has not, from their fingerprints: ``section``, ``paragraph`` (both from 0) and
    ``length``, in order.  Equal roots end the walk at once, sections that the other text has are passed over, and in the
    rest the paragraphs are looked up."""
    def sections(tree: Column) -> Column:
        return F.split(F.substring_index(tree, "|", -1), ";", -1)

    def in_section(s: Column, i: Column, theirs: Column) -> Column:
        own = F.transform(F.split(F.substring(s, SECTION_HEX + 2, 1 << 30), ",", -1), lambda p, j: F.struct(
            i.alias("section"), j.alias("paragraph"), F.substring(p, PARAGRAPH_HEX + 2, 20).cast("int").alias("length"), p.alias("p")))
        return F.filter(own, lambda p: ~F.array_contains(theirs, p["p"]))

    def walk(known: Column) -> Column:
        found = F.transform(sections(a), lambda s, i: F.when(
            ~F.array_contains(known["sections"], F.substring(s, 1, SECTION_HEX)), in_section(s, i, known["paragraphs"])))
        return F.transform(F.flatten(F.filter(found, lambda f: f.isNotNull())), lambda p: F.struct(
            p["section"].alias("section"), p["paragraph"].alias("paragraph"), p["length"].alias("length")))

    known = F.struct(F.transform(sections(b), lambda s: F.substring(s, 1, SECTION_HEX)).alias("sections"),
                     paragraphs(b).alias("paragraphs"))
    same = F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1)
    none = F.array().cast("array<struct<section:int,paragraph:int,length:int>>")
    return F.when(same, none).otherwise(F.transform(F.array(known), walk)[0])


def _weight(found: Column) -> Column:
    """Characters of paragraphs, and one for each, so that empty ones count."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, p: total + F.substring(
        p, PARAGRAPH_HEX + 2, 20).cast("long") + 1)


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts lies in paragraphs that both have, from their fingerprints: 0 to 1."""
    pair = F.struct(paragraphs(a).alias("a"), paragraphs(b).alias("b"))
    return F.transform(F.array(pair), lambda p: F.lit(2.0) * _weight(F.array_intersect(p.a, p.b)) / (
        _weight(p.a) + _weight(p.b)))[0]


def in_circle(keys: DataFrame) -> DataFrame:
    """Who comes before each row of ``doc_id, h, n`` in descending order of ``doc_id, h``; before the first, the last.

    Rows are dealt by range.  Within a range a window tells the neighbour; between ranges it is the last row of the
    range before, of a table with one row per range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    ranged = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("range").orderBy(*order)
    numbered = ranged.select("*", F.row_number().over(within).alias("k"), *(
        F.lag(c).over(within).alias(f"user_{c}") for c in ("doc_id", "h", "n")))
    ends = ranged.groupBy("range").agg(F.min(F.struct(  # descending order: the least row of a range is its last
        F.col("doc_id").isNotNull().alias("has"), "doc_id", "h", "n")).alias("end"))
    around = Window.orderBy("range")
    previous = ends.select("range", F.coalesce(F.lag("end").over(around), F.last("end").over(
        around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    first = F.col("k") == 1
    return numbered.join(F.broadcast(previous), "range").select(
        "doc_id", "h", *(F.when(first, F.col(f"end.{c}")).otherwise(F.col(f"user_{c}")).alias(f"user_{c}")
                         for c in ("doc_id", "h", "n")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, fingerprint`` of every row; null texts count as empty, other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("fingerprint", fingerprint(F.col("text")))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    The edited text ends with the beginning of the next document in descending order of ids instead of its own second
    half.  Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id``.
    Rows with one
    id and text are one document in the circle and each get its result; documents that share an id follow each other by
    the hash of their texts; a null id comes last.  A single document is its own next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def key(doc_id: Column, h: Column) -> Column:
        """One column that is never null, so that all steps below share one partitioning; null ids are skipped."""
        return F.md5(F.concat_ws("|", doc_id.cast("string"), h))

    users = in_circle(rows.groupBy("doc_id", F.md5("text").alias("h")).agg(F.max(F.char_length("text")).alias("n")))
    users = users.select(key(F.col("doc_id"), F.col("h")).alias("k"),
                         key(F.col("user_doc_id"), F.col("user_h")).alias("user_k"), "user_n")
    rows = rows.select(key(F.col("doc_id"), F.md5("text")).alias("k"), "doc_id", "text")
    lent = rows.join(users, "k").select(
        F.col("user_k").alias("k"), F.expr("left(text, user_n div 2)").alias("borrowed"),
        fingerprint(F.col("text")).alias("next_fingerprint"), F.col("doc_id").alias("next_doc_id"))
    # Both joins read the same columns of the documents, so these are shuffled once.
    both = rows.join(lent.dropDuplicates(["k"]), "k").select(
        "doc_id", "next_doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "borrowed", "next_fingerprint")
    both = both.select("doc_id", "next_doc_id", "n_chars", "next_fingerprint", "text", F.concat(
        F.expr("left(text, n_chars - n_chars div 2)"), "borrowed").alias("edited"))
    both = both.select("doc_id", "next_doc_id", "n_chars", "edited", "next_fingerprint", fingerprint(F.col("text")).alias("fingerprint"),
                       fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return both.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_doc_id")


#: The same over ``documents`` in SQL, with whole-table order instead of ranges.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text,
           md5(coalesce(text, '')) AS h FROM documents)),
n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER w, first(text) OVER (
        ORDER BY doc_id DESC NULLS LAST, h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text,
        CASE WHEN lead(1) OVER w = 1 THEN lead(doc_id) OVER w ELSE first(doc_id) OVER (
        ORDER BY doc_id DESC NULLS LAST, h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        END AS next_doc_id
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, h DESC)),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n),
x AS (SELECT r, unnest([1, 2, 3]) AS kind, unnest([text, edited, next_text]) AS x FROM e),
l AS (SELECT r, kind, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i
      FROM x),
c AS (SELECT r, kind, i, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '{PARAGRAPH}') END AS ps FROM l),
p AS (SELECT r, kind, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM c),
s AS (SELECT r, kind, i, md5(string_agg(md5(p), ',' ORDER BY j)) AS h,
             string_agg(left(md5(p), 8) || '.' || length(p), ',' ORDER BY j) AS ps FROM p GROUP BY ALL),
f AS (SELECT r, kind, sha256(string_agg(h, ';' ORDER BY i)) || '|'
             || string_agg(left(h, 16) || ':' || ps, ';' ORDER BY i) AS f FROM s GROUP BY ALL),
u AS (SELECT DISTINCT r, kind, left(md5(p), 8) || '.' || length(p) AS p, length(p) + 1 AS weight FROM p),
g AS (SELECT r, p, max(weight) AS weight, list(kind) AS kinds FROM u GROUP BY ALL),
w AS (SELECT r, sum(weight) FILTER (list_contains(kinds, 1)) AS w1, sum(weight) FILTER (list_contains(kinds, 2)) AS w2,
             sum(weight) FILTER (list_contains(kinds, 3)) AS w3,
             coalesce(sum(weight) FILTER (list_contains(kinds, 1) AND list_contains(kinds, 2)), 0) AS w12,
             coalesce(sum(weight) FILTER (list_contains(kinds, 1) AND list_contains(kinds, 3)), 0) AS w13
      FROM g GROUP BY r)
SELECT e.doc_id, CAST(e.n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint,
       b.f AS edited_fingerprint, CAST(2.0 AS DOUBLE) * CAST(w12 AS DOUBLE) / CAST(w1 + w2 AS DOUBLE) AS near_edited,
       CAST(2.0 AS DOUBLE) * CAST(w13 AS DOUBLE) / CAST(w1 + w3 AS DOUBLE) AS near_next, next_doc_id
FROM documents o JOIN e ON o.doc_id IS NOT DISTINCT FROM e.doc_id AND coalesce(o.text, '') = e.text
JOIN f a ON a.r = e.r AND a.kind = 1 JOIN f b ON b.r = e.r AND b.kind = 2 JOIN w ON w.r = e.r
"""
