import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import decontaminate, embeddingdedup, jaccardjoin, langid, linededup, quality, sentencepiece, suffixdedup, toxicity, unitdedup
from veilspark.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos string, node string, cut string, found string, kind string, score string"


def frame(spark, docs):
    """Documents with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "h", "p", "n", "c", "f", "k", "s") for i, t, lang in docs], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) if r.random() < 0.5 else f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (5, 40, 90)]
    shared = prose(2, 40)
    rows = [(1, base, "en"), (2, base, "en"), (5, near[0], "fr"), (4, near[1], "en"), (3, near[2], None), (6, None, "en"), (7, "", None), (8, "  \n ", "en"), (9, "one two", "de"), (10, "One  TWO", "de"),
            (11, prose(3, 60) + "\n" + shared, "en"), (12, shared + "\n" + prose(4, 60), "en"), (13, "é😀 " * 200, "en"), (14, prose(5, 20000), "en"), (15, "ab" * 300, "en"), (16, "\n".join([shared, prose(6, 9)] * 3), "en")]
    return rows


def test_suffix_dedup_is_exact(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.removal_report(frame(spark, docs)).collect()}
    assert got == brute.suffix_dedup({i: t for i, t, _ in docs})
    assert got[2][1] == got[2][0] and got[12][1] > 100 and got[1][1] == 0


def test_suffix_sort_falls_back_on_collisions(monkeypatch):
    import numpy as np

    rows = np.random.default_rng(0).integers(0, 3, (40, 9)).astype(np.int16)
    begin, size = np.zeros(40, np.int64), np.full(40, 40)
    order, lcp = suffixdedup.sorted_suffixes(rows, begin, size)
    assert [tuple(rows[k]) for k in order] == sorted(map(tuple, rows))
    # a hash under which everything is equal: the bytes decide
    monkeypatch.setattr(suffixdedup, "powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    again, lcp2 = suffixdedup.sorted_suffixes(rows, begin, size)
    assert [tuple(rows[k]) for k in again] == sorted(map(tuple, rows)) and (lcp2 == lcp).all()


def test_suffix_dedup_of_hot_anchors(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.removal_report(frame(spark, docs)).collect()}
    assert got == brute.suffix_dedup({i: t for i, t, _ in docs})


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_join_is_exact(spark, docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.component_report(frame(spark, docs), n, percent).collect()}
    assert got == brute.jaccard({i: t for i, t, _ in docs}, n, percent)
    assert got[2][1] == 1 and got[10][1] == 9 and got[7] == (0, 7)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    base = prose(7, 60).split()
    r = random.Random(3)
    rows = {k: " ".join(w if r.random() > 0.025 else f"y{r.randrange(99)}" for w in base) for k in range(60)}
    monkeypatch.setattr(jaccardjoin, "BLOCK_ROWS", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.component_report(frame(spark, [(k, t, "en") for k, t in rows.items()])).collect()}
    assert got == brute.jaccard(rows)


def test_line_and_unit_dedup(spark, docs):
    lines = {r.doc_id: r for r in linededup.line_report(frame(spark, docs)).collect()}
    assert len(lines) == len(docs)
    assert (lines[16].n_lines, lines[16].n_removed, lines[16].n_runs, lines[16].longest_run) == (6, 4, 1, 4)
    assert lines[6].n_removed == 0 and lines[6].n_lines == 1
    kept = {r.doc_id: r.text for r in linededup.deduplicated(frame(spark, docs)).collect()}
    assert kept[6] is None and kept[7] == "" and kept[16].count("\n") == 1
    units = {r.doc_id: r for r in unitdedup.unit_report(frame(spark, docs)).collect()}
    text = dict((i, t) for i, t, _ in docs)
    assert units[2].n_removed == 1 and units[1].n_removed == 0 and (units[6].n_units, units[7].n_units) == (0, 1)
    cut = units[12].removed[0]
    assert text[12][cut.start : cut.stop] == text[11].split("\n")[1] + "\n"
    assert units[2].kept_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("least", [1, 6, 25])
def test_unit_dedup_by_a_plain_version(spark, least):
    r = random.Random(least)
    some = ["One two three. ", "Four five\t six!  ", "seven\n", "\n", "Eight nine ten? ", "漢字。", "a.b c", "Z ", "  \n"]
    rows = [(k, "".join(r.choices(some, k=r.randrange(12)))) for k in range(80)] + [(90, None), (91, "")]
    # told again: word for word, and with another text
    rows += [rows[50], rows[51], (52, "One TWO three. Four five six! seven\n" * 3), (None, "One two three. ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {x.text: x.k for x in docs.where("text is not null").selectExpr("text", "xxhash64(text) as k").distinct().collect()}
    want = brute.unit_dedup([x for x in rows if x[0] is not None and x[1] is not None], key, least)
    got = unitdedup.unit_report(docs, least).collect()
    assert len(got) == len(rows) and (least == 25 or sum(x.n_removed for x in got) > 50)
    texts = sorted((x for x in rows if x[0] is not None), key=str)
    for x in got:
        spans = [(c.start, c.stop) for c in x.removed]
        mine = [t for i, t in texts if i == x.doc_id]
        assert any(spans == want.get((x.doc_id, t), []) and x.kept_sha256 == brute.without(t or "", spans) for t in mine) or (x.doc_id is None and not spans)
    assert {r.text for r in unitdedup.kept(docs, least).where("doc_id = 0").collect()} == {rows[0][1]} or least == 1


def test_frequent_units_and_lines_are_dealt_out(spark, monkeypatch):
    from veilspark.llm import shared

    rows = [(k, f"own {k}\nThe same line everywhere. And another.\nown {k} {k}" if k % 3 else f"x {k}") for k in range(120)]
    plain = [[tuple(map(str, r)) for r in sorted(f(spark.createDataFrame(rows, "doc_id long, text string")).collect())] for f in (lambda d: unitdedup.unit_report(d, 1), lambda d: linededup.line_report(d, 1))]
    for module in (shared, linededup):
        monkeypatch.setattr(module, "LIGHT", 0)
    dealt = [[tuple(map(str, r)) for r in sorted(f(spark.createDataFrame(rows, "doc_id long, text string")).collect())] for f in (lambda d: unitdedup.unit_report(d, 1), lambda d: linededup.line_report(d, 1))]
    assert dealt == plain


def test_line_dedup_by_a_plain_version(spark):
    r = random.Random(4)
    rows = [(k // 2, "\n".join(r.choices("abcd", k=r.randrange(30)))) for k in range(60)]  # two texts an id
    long = [f"line {k}" for k in range(200)]
    rows += [(100 + n, "\n".join([f"own {n}", *long[7 : 7 + n], f"end {n}"])) for n in range(1, 10)] + [(200, "\n".join(long)), (201, "\n".join(long[50:180])), (202, None), (None, "a\nb"), (203, rows[5][1]), (203, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {x.t: x.k for x in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as k").distinct().collect()}
    for least in (1, 2, 3, 5):
        want = brute.line_dedup([(i, t or "") for i, t in rows if i is not None], key, least)
        got = {(x.doc_id, x.key): [(c.start, c.stop) for c in x.cut] for x in linededup.deleted(docs, least).collect()}
        assert got == want


def test_line_runs_of_other_lengths(spark):
    rows = [(1, "a\nb\nc\nd\ne", "en"), (2, "x\nb\nc\nd\ny", "en"), (3, "b\nc", "en"), (4, "a\nb\nc\nd\ne\nf", "en")]
    for m, want in ((1, {2: [1, 2, 3], 3: [0, 1], 4: [0, 1, 2, 3, 4]}), (3, {2: [1, 2, 3], 4: [0, 1, 2, 3, 4]}), (5, {4: [0, 1, 2, 3, 4]})):
        got = {r.doc_id: [p for c in r.cut for p in range(c.start, c.stop)] for r in linededup.deleted(frame(spark, rows), m).collect()}
        assert got == want


def test_decontamination(spark, docs):
    item = " ".join(docs[0][1].split()[20:50])
    items = spark.createDataFrame([(1, item, 0), (2, item.upper().replace(" ", ", "), 0), (3, None, 0), (4, "", 0), (5, "one two", 0), (6, prose(99, 30), 0), (None, item, 0)], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(frame(spark, docs), items).collect()}
    # document 4 has another word inside the passage: 21 of 26 shingles, still four fifths
    assert got == {(d, i) for d in (1, 2, 3, 4, 5) for i in (1, 2)} | {(9, 5), (10, 5)}
    left = decontaminate.decontaminated(frame(spark, docs + [(None, item, "en")]), items)
    assert left.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in docs} - {1, 2, 3, 4, 5, 9, 10} | {None}


def test_embedding_dedup(spark):
    import numpy as np

    r = np.random.default_rng(5)
    a = r.normal(size=(12, 16))
    rows = [(k, a[k // 5].tolist() if k % 5 == 0 else (a[k // 5] + r.normal(0, 0.09, 16)).tolist(), k // 30) for k in range(40)]
    rows += [(40, rows[3][1], 0), (41, rows[3][1], None), (42, None, 0), (43, [0.0] * 16, 0), (44, [float("nan")] * 16, 0), (45, [], 0), (46, [1.0, 2.0], 0), (47, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(i, v, x, "u") for i, v, x in rows], "vec_id long, embedding array<double>, label int, unit string")
    df = df.union(spark.createDataFrame([(48, [None, 1.0], 0, "u")], df.schema))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddingdedup.near_duplicate_report(df).collect()}
    want = brute.near_vectors(rows + [(48, [None, 1.0], 0)])
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_embedding_dedup_at_the_threshold(spark):
    """Planted pairs just above the threshold: counts agree on both sides, and recall is measured against brute force."""
    import numpy as np

    r = np.random.default_rng(9)
    a = r.normal(size=(3000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    turn = r.normal(size=a.shape)
    turn -= (turn * a).sum(axis=1)[:, None] * a
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    c = r.uniform(0.931, 0.97, len(a))[:, None]
    v, label = np.concatenate((a, c * a + np.sqrt(1 - c * c) * turn)), np.tile(np.arange(3000) % 3, 2)
    df = spark.createDataFrame([(k, x.tolist(), int(y)) for k, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddingdedup.near_duplicate_report(df).collect()}
    links = np.array([got[k][0] for k in range(len(v))])
    assert (links[:3000] == links[3000:]).all() and links.sum() >= 0.99 * 6000 and links.max() == 1
    assert all((got[k + 3000][1] == k) == (links[k] == 1) for k in range(3000))


def test_embedding_dedup_of_clashing_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [0.0, 1.0], 0), (4, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddingdedup.near_duplicate_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4), (4, 1, 4)]


def test_scores_by_plain_versions():
    """Scoring against loops over words and n-grams, and decoding against every codeword."""
    import math

    import numpy as np

    r = np.random.default_rng(2)
    texts = [prose(3, 30), "", None, "one", "é😀 ü, ab ab ab", "  x  "]
    table = r.normal(size=quality.SIZE).astype(np.float32)
    got = quality.scores({"table": table, "bias": np.array(0.25)}, texts)
    for t, p in zip(texts, got):
        ids, share = quality.bag(t)
        assert abs(p - 1 / (1 + math.exp(-(float(table[ids] @ share) + 0.25)))) < 1e-6
    width = sum(w * toxicity.FILTERS for w in toxicity.WIDTHS)
    model = {"table": r.normal(size=(toxicity.NONE + 1, width)).astype(np.float32), "fb": r.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), "out": r.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), "bias": np.array(0.1), "speech": r.normal(size=(toxicity.NONE + 1, 2))}
    model["table"][toxicity.NONE] = 0
    z, lang = toxicity.logits(model, texts)
    for k, t in enumerate(texts):
        (_, ids, _), = toxicity.sequences([t])
        n, best, at = ids.shape[1] - max(toxicity.WIDTHS) + 1, [], 0  # as in training: at each word and at the first NONE
        for w in toxicity.WIDTHS:
            best.append(np.max([sum(model["table"][i[p + o], at + o * toxicity.FILTERS : at + (o + 1) * toxicity.FILTERS] for o in range(w) for i in ids) for p in range(n)], axis=0))
            at += w * toxicity.FILTERS
        assert abs(np.maximum(0, np.concatenate(best) + model["fb"]) @ model["out"] + 0.1 - z[k]) < 1e-3
        assert lang[k] == model["speech"][ids[1]].sum(axis=0).argmax()
    code = langid.codewords(5)
    m, weight = r.normal(size=(40, code.shape[1])), np.full(code.shape[1], 1 / code.shape[1])
    best, score, odd = langid.decode({"code": code, "weight": weight}, m)
    for k, row in enumerate(m):
        loss = [sum(w * math.log1p(math.exp(-x * c)) for x, c, w in zip(row, word, weight)) for word in code]
        assert best[k] == loss.index(min(loss)) and 0 <= score[k] <= 1
    tie = langid.decode({"code": code, "weight": weight}, np.zeros((1, code.shape[1])))
    assert tie[0][0] == 0 and tie[2][0]


def test_repeated_rows_and_null_ids(spark):
    text = prose(8, 60)
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, "en"), (3, None, None)]
    docs = frame(spark, rows)
    assert sorted((r.doc_id, r.n_removed > 0) for r in suffixdedup.removal_report(docs).collect()) == [(1, False), (1, False), (2, True), (3, False)]
    assert sorted((r.doc_id, r.component_id) for r in jaccardjoin.component_report(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in linededup.line_report(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1), (3, 0)]
    items = spark.createDataFrame([(7, text)] * 2, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()) == [(1, 7), (2, 7)]
    pieces = sentencepiece.tokenized(docs).collect()
    assert len(pieces) == 5 and sum(r.doc_id is None for r in pieces) == 1 and len({tuple(r.ids) for r in pieces}) == 2


def test_sentencepiece_round_trip(spark, docs):
    got = {r.doc_id: r for r in sentencepiece.tokenized(frame(spark, docs + [(20, " a  b ▁ <s> \u0000\t漢", "en")])).collect()}
    assert all(r.parity for r in got.values())
    assert [i for i, r in got.items() if not r.exact] == [20]  # a marker in the text decodes to a space
    assert got[6].ids == [] and got[7].n_tokens == 0


def test_sentencepiece_parity_on_odd_texts():
    import sentencepiece as sp

    r = random.Random(1)
    texts = ["".join(r.choices(list("ab \n\tÉß▁漢😀.,  é<s>0"), k=r.randint(0, 40))) for _ in range(2000)]
    own = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    pipeline = sentencepiece.loaded(sentencepiece.MODEL)
    ids = pipeline.encode(texts)
    assert ids == own.encode(texts) and all(pipeline.parity(texts, ids))
    assert not any(pipeline.parity(["ab cd"], [[1, 2, 3]]))
    with_control = [[1, *x, 2] for x in ids]
    assert pipeline.decode(ids) == pipeline.decode(with_control) == own.decode(ids)


def test_unigram_model_is_rebuilt(spark, tmp_path):
    def number(v):
        out = b""
        while True:
            out += bytes([v & 0x7F | (0x80 if v > 0x7F else 0)])
            v >>= 7
            if not v:
                return out

    import struct

    def part(n, raw):
        return number(n << 3 | 2) + number(len(raw)) + raw

    pieces = [("<unk>", 0, 2), ("▁", -2, 1), ("▁a", -1, 1), ("b", -3, 1), ("ab", -1.5, 1), ("a", -3, 1)] + [(f"<0x{k:02X}>", -9, 6) for k in range(256)]
    data = b"".join(part(1, part(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(k)) for p, s, k in pieces)
    data += part(2, number(3 << 3) + number(1) + number(35 << 3) + number(1)) + part(3, number(3 << 3) + number(1) + number(4 << 3) + number(0))
    import sentencepiece as sp

    own = sp.SentencePieceProcessor(model_proto=data)
    t = sentencepiece.tokenizer_of(sentencepiece.parsed(data))
    for text in ("ab ab", "a", "", "b  ab", "é a"):
        assert t.encode(text, add_special_tokens=False).ids == own.encode(text), text
    (tmp_path / "unigram.model").write_bytes(data)
    texts = ["ab ab", "", None, "b  ab", "é a" * 50]
    rows = sentencepiece.tokenized(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string"), str(tmp_path / "unigram.model")).collect()
    assert all(r.parity and r.exact and list(r.ids) == own.encode(texts[r.doc_id] or "") for r in rows) and len(rows) == 5


def _labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        bad = r.random() < 0.3
        lang = r.choice(["en", "fr"])
        t = prose(k, r.randint(20, 80)) + (" le la une" if lang == "fr" else " the of and") * 3
        if bad:
            t += f" {'vilain' if lang == 'fr' else 'nasty'} " + prose(k + 9000, 8)
        rows.append((k, t, lang))
        labels.append((k, int(not bad), int(bad), "x"))
    labels += [(1, None, None, "x"), (None, 1, 1, "x"), (99999, 1, 0, "x"), labels[5]]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers_hold_out(spark):
    rows, labels = _labelled(spark)
    docs = frame(spark, rows + [(700, None, None), (701, "", "en"), (702, "1234", None), (None, "the of and", "en"), (5, rows[5][1], "en")])
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    for report, column in ((quality.quality_report, "quality"), (toxicity.toxicity_report, "toxic")):
        got = report(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 80 and sum(r.predicted == truth[r.doc_id][column] for r in held) / len(held) > 0.9
    got = langid.language_report(docs).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) / len(held) > 0.95
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (700, 701, 702)} == {700: "und", 701: "und", 702: "und"}


def test_codewords_are_apart():
    for k in (1, 2, 4, 5, 9, 20):
        c = langid.codewords(k)
        assert len({tuple(r) for r in c.tolist()}) == k


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for out in (
        suffixdedup.removal_report(none), jaccardjoin.component_report(none), linededup.line_report(none), unitdedup.unit_report(none), decontaminate.contaminated_pairs(none, items),
        quality.quality_report(none, labels), toxicity.toxicity_report(none, labels), langid.language_report(none), sentencepiece.tokenized(none), embeddingdedup.near_duplicate_report(vectors),
    ):
        assert out.count() == 0
    some = frame(spark, [(1, "text", "en")])
    assert decontaminate.decontaminated(some, items).count() == 1 and toxicity.without_toxic(some, labels).count() == 1
    assert quality.quality_report(some, labels).first().score == 0.5
    assert langid.language_report(some.withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"


def test_components_settle_or_say_so(spark):
    """A chain, a star and a pair; too few steps are an error, never a part of the result."""
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(100, k) for k in range(101, 160)]
    links = [*chain, *star, (201, 200), (200, 201), (300, 300)]
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute.roots({n for e in links for n in e if e != (300, 300)}, links[:-1])
    assert got == want
    with pytest.raises(RuntimeError):
        components(edges, limit=1)
