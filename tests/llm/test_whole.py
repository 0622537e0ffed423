"""Operators on cases that an earlier cut had left out."""

import random

import duckdb
import pytest

from veilspark.llm import linededup, sentencepiece, unitdedup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def test_single_line_passages(spark):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    spaceless = "漢" * 100
    rows = [(1, f"a\n{words(51)}\nb"), (2, f"c\n{words(51)}\nd"), (3, f"e\n{words(50)}\nf"), (4, f"g\n{words(50)}\nh"), (5, spaceless), (6, f"i\n{spaceless}\n{spaceless}"), (7, "j\n" + "漢" * 99), (8, "k\n" + "漢" * 99), (9, "i\n" + " ".join("ab" * 26)), (10, " ".join("ab" * 26) + "\nl")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for m in (2, 3):
        assert {r.doc_id: [tuple(c) for c in r.cut] for r in linededup.deleted(docs, m).collect()} == {2: [(1, 2)], 6: [(1, 3)], 10: [(0, 1)]}


def test_line_dedup_leaves_no_later_passage(spark):
    """The result against a plain version: pairs of lines, and passages, that occur earlier."""
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()
    seen, alone, want = set(), set(), {}
    for i, text in docs:
        lines, cut = (text or "").split("\n"), set()
        for k, line in enumerate(lines):
            if k + 1 < len(lines):
                if (pair := (line, lines[k + 1])) in seen:
                    cut |= {k, k + 1}
                seen.add(pair)
            if line in alone and (len(line.split()) > 50 or len(line.encode()) >= 300):
                cut.add(k)
            alone.add(line)
        if cut:
            want[i] = sorted(cut)
    got = {r.doc_id: [p for c in r.cut for p in range(c.start, c.stop)] for r in linededup.deleted(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want


def test_short_units_and_passages_within_lines(spark):
    passage = " ".join(f"Word{k} goes on and on here." for k in range(9))
    docs = spark.createDataFrame([(1, "Yes.\n漢字かな\n\n  "), (2, "new\n yes.\n\n \t"), (3, "漢字かな"), (4, f"Own start of {passage} Own end."), (5, f"Quite other words. Then {passage} Other end.")], SCHEMA)
    assert {(r.doc_id, tuple(map(tuple, r.cut))) for r in unitdedup.removed_units(docs, 1).collect()} == {(2, ((1, 1),)), (3, ((0, 0),)), (5, ((2, 9),))}
    # by default short repeats are no passage, and a passage is found within a line
    assert {(r.doc_id, tuple(map(tuple, r.cut))) for r in unitdedup.removed_units(docs).collect()} == {(5, ((2, 9),))}


def test_sentencepiece_keeps_large_ids_beside_a_null_one(spark):
    ids = [2**60 + 1, None, 2**53 + 1, 5]
    rows = sentencepiece.tokenized(spark.createDataFrame([(i, "some text") for i in ids], SCHEMA).coalesce(1)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 5, 2**53 + 1, 2**60 + 1] and all(r.parity and r.exact for r in rows)


def test_sentencepiece_encodes_long_texts_as_whole_ones():
    r = random.Random(3)
    texts = ["".join(r.choices("ab \n\tÉß▁漢😀.,  é<s>0", k=r.randint(900, 9000))) for _ in range(100)]
    texts += [" " * 5000, "a " * 3000, "▁" * 2500, "x" * 5000, "x" * 1000 + "  " + "y" * 1000, "a" + " " * 3000 + "b", "", " "]
    p = sentencepiece.loaded(sentencepiece.MODEL)
    assert p.sections and max(len(sentencepiece.SECTION.findall(t.replace(" ", "▁"))) for t in texts) > 5
    assert all("".join(sentencepiece.SECTION.findall(t)) == t for t in texts)
    ids = p.encode(texts)
    assert ids == p.other.encode(texts) and all(p.parity(texts, ids)) and p.decode(ids) == p.other.decode(ids)


@pytest.mark.parametrize("piece,sections", [("▁a", True), ("▁▁", True), ("a▁b", False)])
def test_sentencepiece_has_no_sections_where_a_piece_crosses_them(monkeypatch, piece, sections):
    own = sentencepiece.parsed
    monkeypatch.setattr(sentencepiece, "parsed", lambda data: (m := own(data), m.pieces.__setitem__(-1, (piece, -1.0, 1)))[0])
    monkeypatch.setattr(sentencepiece, "tokenizer_of", lambda m: type("T", (), {})())
    with open(sentencepiece.MODEL, "rb") as f:
        assert sentencepiece.Pipeline(f.read()).sections == sections
