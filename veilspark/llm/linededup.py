"""Line-run dedup: a suffix array over line-ID sequences by distributed prefix doubling. DataFrame functions only.

Every document is a sequence of line IDs, and a suffix is a place in it. Prefix doubling gives each suffix the name of
its first 2k lines from the pair of names of its two halves of k lines. Suffixes of one name are an interval of the
suffix array whose longest common prefix is k or more; the interval's name is its earliest suffix, so names are exact,
not hashes, and say at once whether a suffix has an earlier copy. A suffix alone in its interval can't repeat with any
greater length and is dropped; doubling goes on until all are. A length ``min_lines`` that is no power of two is named from
two overlapping halves, and doubling goes on from there.

Each suffix that isn't its interval's earliest gives a repeated run of k lines. A common prefix of any length between k
and 2k is covered by two overlapping ones of k, so the runs of all intervals, joined where they overlap, are the maximal
repeated runs. They are deleted where they hold ``min_lines`` lines or more, or a line that is a passage by itself.

The first names group lines by their 128-bit digest: among 10**12 different lines two are taken for equal with a chance
of some 10**-15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import LIGHT, discard, with_cuts, with_first, written

#: A line of more words than this, or of so many bytes (for scripts without spaces), is a passage by itself.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 300


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def passage(line: Column) -> Column:
    """Whether a line is long enough to be deleted without equal neighbours: over 50 words, or 300 bytes of UTF-8 or more."""
    size = F.octet_length(line)
    # 51 words take 101 bytes at least
    return (size >= PASSAGE_BYTES) | ((size > 2 * PASSAGE_WORDS) & (F.size(F.split(F.trim(line), r"\s+")) > PASSAGE_WORDS))


def _row_key() -> Column:
    """Tells rows of equal doc_id and different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _named(rows: DataFrame, count: int, by: list[str]) -> DataFrame:
    """The intervals of two suffixes or more, by equal ``by``: ``name`` is the earliest suffix, ``later`` all but that."""
    return with_first(rows, count, by).withColumn("name", F.struct("first.doc_id", "first.key", "first.pos"))


def _further(names: DataFrame, lines: int) -> DataFrame:
    """Adds ``next``, the name of the suffix ``lines`` further on, and drops suffixes where there is none that repeats."""
    w = Window.partitionBy("doc_id", "key").orderBy("pos").rangeBetween(lines, lines)
    return names.withColumn("next", F.max("name").over(w)).where("next is not null").select("doc_id", "key", "pos", "name", "next")


def intervals(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, key, pos, lines, passage) of each suffix at each doubled length at which it has an earlier copy.

    ``key`` tells rows of one doc_id apart; rows that are told again word for word count as one. Rows without doc_id are
    left out. The doubling takes as many rounds as the longest repeated run has binary digits.
    """
    rows = docs.where("doc_id is not null").select("doc_id", _row_key().alias("key"), F.posexplode_outer(lines_of(F.col("text"))).alias("pos", "line"))
    rows = written(rows.select("doc_id", "key", F.col("pos").cast("long").alias("pos"), F.unhex(F.md5("line")).alias("digest"), passage(F.col("line")).alias("passage")))
    names = written(_named(rows, rows.count(), ["digest"]).select("doc_id", "key", "pos", "name", "later", "passage"))
    discard(rows)
    found = names.where("later").select("doc_id", "key", "pos", F.lit(1).alias("lines"), "passage")
    lines = 1
    while count := names.count():
        step = min(lines, min_lines - lines) if lines < min_lines else lines
        rows = _further(names, step) if count < LIGHT else written(_further(names, step))
        lines += step
        names = written(_named(rows, count, ["name", "next"]).select("doc_id", "key", "pos", "name", "later"))
        discard(rows)
        found = found.union(names.where("later").select("doc_id", "key", "pos", F.lit(lines).alias("lines"), F.lit(False)))
    return found


def _joined(found: Column) -> Column:
    """(start, stop) of sorted runs, those that overlap or touch as one."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    none = F.struct(F.array().cast(kind).alias("out"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"))
    closed = lambda a: F.when(a["start"] >= 0, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))).otherwise(a["out"])

    def step(a: Column, r: Column) -> Column:
        on = r["start"] <= a["stop"]
        return F.struct(F.when(on, a["out"]).otherwise(closed(a)).alias("out"), F.when(on, a["start"]).otherwise(r["start"]).alias("start"), F.greatest(a["stop"], r["stop"]).alias("stop"))

    return F.aggregate(found, none, step, closed)


def deleted(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, key, cut): the maximal runs to delete as (start, stop) line numbers from 0, in order, for rows that lose any.

    A run goes that also starts earlier: in a smaller doc_id, or in the same row at a smaller line number. Runs are judged
    on the input, and have ``min_lines`` lines or more or are one passage().
    """
    found = intervals(docs, min_lines).where((F.col("lines") >= min_lines) | F.col("passage"))
    run = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("lines")).alias("stop"))
    return found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(run)).alias("runs")).select("doc_id", "key", _joined(F.col("runs")).alias("cut"))


def kept_text(text: Column, cut: Column) -> Column:
    """The text without the cut lines; a text that loses none stays as it is, null included."""
    left = F.filter(lines_of(text), lambda x, i: ~F.exists(cut, lambda c: (c["start"] <= i) & (i < c["stop"])))
    return F.when(cut.isNull(), text).otherwise(F.array_join(left, "\n"))


def line_report(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, n_runs (maximal deleted runs), longest_run, kept_sha256.

    A null or empty text is one empty line. Rows with a null doc_id lose nothing. Of rows that share a doc_id, each text is
    a document of its own, ranked by a hash; equal ones count as one and are cut alike. Places rank by (doc_id, hash,
    line), so there are no ties. An empty table gives an empty result. Further columns are ignored.
    """
    cut = F.col("cut")
    sizes = F.transform(cut, lambda c: c["stop"] - c["start"])
    d = with_cuts(docs.select("doc_id", "text", _row_key().alias("key")), written(deleted(docs, min_lines)), ["doc_id", "key"])
    return d.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.when(cut.isNull(), 0).otherwise(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)).cast("long").alias("n_removed"),
        F.when(cut.isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_runs"),
        F.when(cut.isNull(), 0).otherwise(F.array_max(sizes)).cast("long").alias("longest_run"),
        F.sha2(F.coalesce(kept_text(F.col("text"), cut), F.lit("")), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """``docs`` with the repeated runs and passages deleted from text and n_chars, if any, counted again; columns stay as they are.

    A document all of whose lines are deleted goes; one whose text was null or empty before stays. Nulls, repeated rows,
    empty tables and further columns as in line_report().
    """
    # the rows as one struct, so that no name of theirs can clash
    cuts = written(deleted(docs, min_lines))
    rows = with_cuts(docs.select("doc_id", _row_key().alias("key"), F.struct(*docs.columns).alias("row")), cuts, ["doc_id", "key"])
    cut, row = F.col("cut"), F.col("row")
    text = kept_text(row["text"], cut)
    out = rows.select("cut", "row", text.alias("left")).where("cut is null or left <> ''")
    fresh = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(cut.isNull(), row["n_chars"]).otherwise(F.length("left").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(fresh.get(c, row[c]).alias(c) for c in docs.columns))


def oracle(min_lines: int = 2) -> str:
    nexts = ", ".join(f"lead(line, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{i}" for i in range(1, min_lines))
    keys = ", ".join(["line", *(f"l{i}" for i in range(1, min_lines))])
    full = " AND ".join([f"l{min_lines - 1} IS NOT NULL"] if min_lines > 1 else ["true"])
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
r AS (SELECT *{', ' + nexts if nexts else ''} FROM x),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, pos) AS rn FROM r WHERE {full}),
p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS rn FROM x WHERE strlen(line) >= {PASSAGE_BYTES} OR len(string_split_regex(trim(line), '\s+')) > {PASSAGE_WORDS}),
c AS (SELECT DISTINCT doc_id, pos + o AS pos FROM f, range(0, {min_lines}) t(o) WHERE rn > 1 UNION SELECT doc_id, pos FROM p WHERE rn > 1),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
h AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY ALL),
i AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM h GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.pos) AS t FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN i USING (doc_id) LEFT JOIN k USING (doc_id)
"""
