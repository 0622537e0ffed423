"""Substring dedup by hashing the units of a text: repeated passages go, their earliest occurrence stays.

Lines are cut into sentences, so that a passage is found wherever it stands within a line. Units are normalised, their
digests grouped over the whole corpus, and the occurrence of least rank (doc_id, position) of each stays. Of the others,
adjacent ones form a run; a run of ``min_words`` words or more is a repeated passage and is removed, by the offsets that
its units have in the original text. Shorter runs are phrases that texts share without having copied each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import with_cuts, with_first, written

#: Least words of a run of repeated units that is removed. A passage of over 50 words keeps about half of them in whole
#: sentences if it begins and ends within sentences. 1 removes every repeated unit.
MIN_WORDS = 25
#: Where a unit ends: after a line's end, and after an end mark and a blank.
UNIT_END = r"(?<=[.!?…][ \t]|[\n。！？])"


def normalised(unit: Column) -> Column:
    """ASCII letters lowered, runs of blanks as one space, none at the ends."""
    low = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t\n\r\f\x0B]+", " "))


def parts(text: Column) -> Column:
    """The units of a text; end to end they are the text."""
    return F.split(text, UNIT_END, -1)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, seq, pos, words, digest) of every unit that isn't blank: ``seq`` counts these, ``pos`` all units of the row.

    ``key`` is a hash of the text, which tells rows of equal doc_id and different texts apart.
    """
    norm = F.transform(parts(F.col("text")), lambda u, i: F.struct(i.alias("pos"), normalised(u).alias("norm")))
    lean = F.transform(F.filter(norm, lambda u: u["norm"] != ""), lambda u: F.struct(u["pos"].alias("pos"), F.size(F.split(u["norm"], " ")).alias("words"), F.unhex(F.md5(u["norm"])).alias("digest")))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.posexplode_outer(lean).alias("seq", "u"))
    # the outer form, since the inner one would compute the array twice: once more to filter empty ones out beforehand
    return rows.where("seq is not null").select("doc_id", "key", "seq", "u.pos", "u.words", "u.digest")


def _runs(found: Column, least: int) -> Column:
    """(first, last) unit of each run of adjacent units with ``least`` words or more; ``found`` is sorted by seq."""
    kind = "array<struct<first:int,last:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(-2).alias("seq"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("words"))

    def closed(a: Column) -> Column:
        return F.when((a["words"] >= least) & (a["first"] >= 0), F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"))))).otherwise(a["out"])

    def step(a: Column, u: Column) -> Column:
        on = u["seq"] == a["seq"] + 1
        return F.struct(F.when(on, a["out"]).otherwise(closed(a)).alias("out"), u["seq"].alias("seq"), F.when(on, a["first"]).otherwise(u["pos"]).alias("first"), u["pos"].alias("last"), (F.when(on, a["words"]).otherwise(0) + u["words"]).alias("words"))

    return F.aggregate(found, start, step, closed)


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, cut): the runs of units to remove, as (first, last) unit, for rows that lose any.

    Blank units within a run go with it. Very frequent units are dealt out, not gathered (with_first).
    """
    u = written(units(docs))
    later = with_first(u, u.count(), ["digest"]).where("later")
    # a set: rows that are told again word for word count as one
    found = later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("seq", "pos", "words"))).alias("found"))
    return found.select("doc_id", "key", _runs(F.col("found"), min_words).alias("cut")).where("size(cut) > 0")


def _attached(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text, parts and cut of every row; ``cut`` is null for rows that lose nothing."""
    d = with_cuts(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), written(removed_units(docs, min_words)), ["doc_id", "key"])
    return d.select("doc_id", "text", parts(F.col("text")).alias("parts"), "cut")


def unit_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, n_units, n_removed, removed (start and stop of each removed run, in order), kept_sha256.

    Offsets are characters of the original text, stop exclusive. A null text has no unit, an empty one a single blank
    one; both lose nothing, as do rows with a null doc_id. Rows that share a doc_id are ranked by a hash of their texts;
    if their texts are equal, too, they count as one and are cut alike. Equal units are told apart by rank, so there are
    no ties. An empty table gives an empty result. Further columns are ignored.
    """
    p, cut = F.col("parts"), F.col("cut")
    size = lambda a, n: F.length(F.array_join(F.slice(p, a + 1, n), "")).cast("long")
    spans = F.transform(cut, lambda c: F.struct(size(F.lit(0), c["first"]).alias("start"), size(F.lit(0), c["last"] + 1).alias("stop")))
    none = cut.isNull()
    return _attached(docs, min_words).select(
        "doc_id",
        F.when(p.isNull(), 0).otherwise(F.size(p)).cast("long").alias("n_units"),
        F.when(none, 0).otherwise(F.aggregate(cut, F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1)).cast("long").alias("n_removed"),
        F.when(none, F.array().cast("array<struct<start:bigint,stop:bigint>>")).otherwise(spans).alias("removed"),
        F.sha2(F.coalesce(_kept(F.col("text"), p, cut), F.lit("")), 256).alias("kept_sha256"),
    )


def _kept(text: Column, p: Column, cut: Column) -> Column:
    left = F.filter(p, lambda x, i: ~F.exists(cut, lambda c: (c["first"] <= i) & (i <= c["last"])))
    return F.when(cut.isNull(), text).otherwise(F.array_join(left, ""))


def kept(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) of every row without its repeated passages."""
    return _attached(docs, min_words).select("doc_id", _kept(F.col("text"), F.col("parts"), F.col("cut")).alias("text"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…][ \t]|[\n。！？])', '\1' || chr(1), 'g'), chr(1)) AS us FROM documents),
x AS (SELECT doc_id, unnest(us) AS unit, unnest(range(0, len(us))) AS pos FROM d),
y AS (SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS norm,
  coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM x),
z AS (SELECT doc_id, pos, start, start + length(unit) AS stop, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS later FROM y WHERE norm <> ''),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM z WHERE later),
r AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, run HAVING sum(words) >= {MIN_WORDS}),
g AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, list({{'start': start, 'stop': stop}} ORDER BY start) AS removed FROM r GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(unit, '' ORDER BY pos) AS kept FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND pos BETWEEN a AND b GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(len(us), 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, []) AS removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
