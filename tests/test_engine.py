import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veilspark.functions import chunks, compare, spans
from veilspark.operators import vectors
from veilspark import __main__ as command_line
from veilspark.plans import models, queries, retrieval, service
from veilspark.sources import config, documents, metadata
from veilspark.streaming.ingest import ingest_stream

SF = "/root/testdata/sf0.001"
GOLDEN = [
    ("en", "Mr. John Smith, born in London on March 5, 1970.", "Mr. [FILTERED_PERSON], born in [FILTERED_BIRTHPLACE]."),
    ("nl", "De heer Carlo Schupp, geboren te Brussel op 2 mei 1980.", "De heer [FILTERED_PERSON], geboren te [FILTERED_BIRTHPLACE] [FILTERED_ADDRESS]."),
    ("fr", "Monsieur Dupont, né à Paris le 14 juillet 1975.", "Monsieur [FILTERED_PERSON], né à Paris le [FILTERED_ADDRESS]."),
    ("fr", "Mme Vanmarcke, résidant à Gand, IBAN BE12 3456 7890 1234.", "Mme [FILTERED_PERSON], résidant à Gand, IBAN BE12 3456 7890 1234."),
]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) > 0
    rows = lambda p: sorted(map(tuple, p[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_goldens(spark):
    df = spark.createDataFrame([(lang, text) for lang, text, _ in GOLDEN], "lang string, text string")
    assert {r.text for r in retrieval.filtered(df).collect()} == {g for *_, g in GOLDEN}


def test_long_runs_and_empty_texts(spark):
    run = " ".join(["Woord"] * 20000)
    df = spark.createDataFrame([("nl", run), ("en", run), ("fr", "rue " + run), ("en", ""), ("en", None), ("en", "12 " + run)], "lang string, text string")
    got = [r.text for r in retrieval.filtered(df).collect()]
    assert got.count(run) == 2 and "" in got and None in got and "[FILTERED_ADDRESS]" in got
    with pytest.raises(ValueError):
        retrieval.filter_all("", "en", spark)


def test_merge_properties(spark):
    import random

    r = random.Random(1)
    rows = []
    for k in range(200):
        rows.append((k, [(s := r.randrange(60), s + r.randrange(1, 9), r.choice(["PHONE", "BE_RRN", "PERSON", "X"]), r.randrange(9)) for _ in range(r.randrange(9))]))
    df = spark.createDataFrame(rows, f"id long, s array<{spans.SPAN}>")
    got = {x.id: [(m.start, m.end, m.label) for m in x.m] for x in df.select("id", spans.merged(F.col("s")).alias("m")).collect()}
    from veilspark.functions.patterns import PRIORITY

    for k, found in rows:
        want = []
        for s, e, label, _ in sorted(found, key=lambda x: (x[0], x[1], x[3], x[2])):
            if want and s < want[-1][1]:
                keep = PRIORITY.get(want[-1][2], 0) >= PRIORITY.get(label, 0)
                want[-1] = (want[-1][0], max(e, want[-1][1]), want[-1][2] if keep else label)
            else:
                want.append((s, e, label))
        assert got[k] == want


def test_chunks(spark):
    df = spark.createDataFrame([("nl", 'Dhr. Jan kwam. Hij ging! "Ja.'), ("en", "U.S. (Mr. X) [FILTERED_X]. Ok"), ("en", "   "), ("en", "")], "lang string, text string")
    got = [r.s for r in df.select(chunks.sentences(F.col("text"), F.col("lang")).alias("s")).collect()]
    assert got == [["Dhr. Jan kwam.", 'Hij ging! "Ja.'], ["U.", "S. (Mr.", "X) [FILTERED_X].", "Ok"], [], []]
    blank = [r.c for r in df.select(chunks.sentence_chunks(F.col("text"), F.col("lang"), 2, 1).alias("c")).collect()]
    assert blank[2] == ["  ", "  ", " "] and blank[3] == []
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunks.sentence_chunks(F.col("text"), F.col("lang"), size, overlap)


def test_names_and_answers(spark):
    df = spark.createDataFrame([(" - Ján  Peeters, JAN peeters. januari", "jan PEETERS"), ("x", "???"), ("ﬁ é", "E"), ("a.b", "ab")], "h string, n string")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(compare.flexible_spans(F.col("h"), F.col("n")).alias("s")).collect()]
    assert got == [[(3, 15), (17, 28)], [], [(2, 3)], [(0, 3)]]
    text = "Tel +32 470 12 34 56, Jan Peeters van Gent."
    answers = spark.createDataFrame([(text, "nl", '{"spans":[{"label":"PHONE","start":3,"end":21},{"label":"PHONE","start":0,"end":5}]}', '{"BIRTHPLACE":[{"start":38,"end":43}]}', 'ok {"persons":[{"given":["Jan"],"family":["Peeters"]}]}')], "text string, lang string, a string, b string, c string")
    assert retrieval.filtered(answers, answers=("a", "b", "c")).first().text == "Tel [FILTERED_PHONE], [FILTERED_PERSON] van [FILTERED_BIRTHPLACE]."


def test_vectors_and_metadata(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vector_id long, embedding array<double>")
    assert [list(r.v) for r in df.select(vectors.l2_normalised(F.col("embedding")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0]]
    hits = vectors.nearest(df, [1.0, 0.0], 0).collect()
    assert [(h.vector_id, h.distance) for h in hits] == [(3, 0.0)]
    lines = spark.createDataFrame([(1, '{"vector_id": 1, "chunk_text": "a"}'), (2, ""), (3, "{bad"), (4, '{"vector_id": "1", "chunk_text": "b", "chunk_index": 4}'), (5, '{"x": 1}')], "line_no long, value string")
    assert [(r.vector_id, r.chunk_text, r.chunk_index) for r in metadata.parsed(lines).collect()] == [(1, "b", 4)]
    out = vectors.with_metadata(df.select("vector_id"), metadata.parsed(lines)).orderBy("vector_id").collect()
    assert (out[0].chunk_text, out[0].source_path, out[1].chunk_text, out[1].chunk_index) == ("b", "", "", -1)


def test_files_config_and_streaming(spark, tmp_path, monkeypatch):
    import json
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Mr. John Smith came.</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>He </w:t></w:r><w:hyperlink><w:r><w:t>left.</w:t></w:r></w:hyperlink></w:p></w:body></w:document>")
    (tmp_path / "in/b.txt").write_bytes(b"  Write to a@b.com now.\xff \n")
    got = {r.source_path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.docx"].text == "Mr. John Smith came.\nHe left." and got["b.txt"].text == "Write to a@b.com now." and len(got["b.txt"].document_id) == 16
    docs = documents.read_documents(spark, str(tmp_path / "in")).withColumn("lang", F.lit("en"))
    docs.write.parquet(str(tmp_path / "stream"))
    index, meta = str(tmp_path / "index"), str(tmp_path / "meta")

    def stream():
        return ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "stream")), index, meta, str(tmp_path / "cp"), redacted_path=str(tmp_path / "out"))

    # a failure between vectors and metadata: the batch tried again must not leave its vectors twice
    real = metadata.append
    monkeypatch.setattr(metadata, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    assert retrieval.stored(spark, index, meta) is None and len(list((tmp_path / "index").iterdir())) == 1
    monkeypatch.setattr(metadata, "append", real)
    for _ in range(2):  # a second run finds nothing new
        stream().awaitTermination()
    hits = retrieval.query_index(spark, "Write to", index, meta, 1).collect()
    assert hits[0].chunk_text == "Write to [FILTERED_EMAIL] now." and retrieval.stored(spark, index, meta).count() == 2
    assert "[FILTERED_PERSON]" in documents.read_sidecar(spark, str(tmp_path / "out"), "a.redacted.txt").first().value
    with pytest.raises(ValueError):
        documents.read_sidecar(spark, str(tmp_path), "../x.txt")
    with pytest.raises(FileNotFoundError):
        retrieval.query_index(spark, "x", str(tmp_path / "none"), meta)
    with pytest.raises(ValueError):
        retrieval.query_index(spark, " ", index, meta)
    (tmp_path / "c.json").write_text(json.dumps({"top_k": 9, "extra": 1}))
    c = config.load(str(tmp_path / "c.json"), chunk_size=10)
    assert (c["top_k"], c["extra"], c["chunk_size"], c["chunk_overlap"]) == (9, 1, 10, 120)
    (tmp_path / "d.json").write_text("[")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.json"))
    assert config.load_or_defaults(str(tmp_path / "d.json")) == config.load(str(tmp_path / "none.json")) == config.DEFAULTS
    (tmp_path / "e.json").write_text("[1]")
    with pytest.raises(config.BrokenSettings):
        config.load(str(tmp_path / "e.json"))


def test_later_batch_and_later_line_win(spark, tmp_path):
    row = lambda text: spark.createDataFrame([(k, "d", "s", k, text) for k in range(20)], "vector_id long, document_id string, source_path string, chunk_index int, chunk_text string")
    for batch in range(12):
        metadata.append(row(f"t{batch}").repartition(3), str(tmp_path / "m"), batch)
    metadata.append(row("t11").limit(0), str(tmp_path / "m"), 12)
    (tmp_path / "m" / f"batch={13:020d}").mkdir()  # begun, not complete
    assert {r.chunk_text for r in metadata.read(spark, str(tmp_path / "m")).collect()} == {"t11"}
    # one file of many splits
    (tmp_path / "one.jsonl").write_text("".join(f'{{"vector_id": {k % 5}, "chunk_text": "{k}"}}\n' for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {r.chunk_text for r in metadata.read(spark, str(tmp_path / "one.jsonl")).collect()} == {str(k) for k in range(19995, 20000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_model_provider(spark):
    def provider(system, user):
        if "persons" in system:
            return '{"persons":[{"given":["Jan"],"family":["Peeters"]}]}'
        if "PHONE" in system:
            raise TimeoutError
        return "nothing found"

    docs = spark.createDataFrame([("Hier woont Jan Peeters.", "nl"), ("", "en"), (None, None)], "text string, lang string")
    got = models.answered(docs, provider)
    assert {r.text for r in retrieval.filtered(got, answers=models.ANSWERS).collect()} == {"Hier woont [FILTERED_PERSON].", "", None}
    assert {r.phone_answer for r in got.collect()} == {None}


def test_service_and_command_line(spark, tmp_path, capsys):
    import io
    import json
    import threading
    import urllib.error
    import urllib.request
    import zipfile

    settings = config.DEFAULTS | {k: str(tmp_path / k) for k in ("index_path", "metadata_path", "redacted_path", "upload_path")}
    api = service.Service(spark, settings)
    assert api.redact({"text": "Mr. John Smith, born in London.", "language_hint": "eng"})["filtered_preview"] == "Mr. [FILTERED_PERSON], born in [FILTERED_BIRTHPLACE]."
    for status, call in ((400, lambda: api.redact({"text": ""})), (400, lambda: api.query({"question": "x", "top_k": 0})), (404, lambda: api.query({"question": "x"})), (400, lambda: api.upload("../a.pdf", b"")),
                         (400, lambda: api.upload("a.docx", b"broken")), (400, lambda: api.redacted("../x.txt")), (404, lambda: api.redacted("x.txt")), (404, lambda: api.tools()["ingest_file"]("/nowhere"))):
        with pytest.raises(service.Refused) as e:
            call()
        assert e.value.status == status
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Write to a@b.com now.</w:t></w:r></w:p></w:body></w:document>')
    assert api.upload("a.docx", docx.getvalue(), "ingest", "a.docx", "en")["ingested_chunks"] == 1
    assert (tmp_path / "upload_path" / "a.docx").read_bytes() == docx.getvalue()
    with pytest.raises(service.Refused):
        api.upload("a.docx", docx.getvalue(), "other")
    assert api.redacted("a.redacted.txt") == "Write to [FILTERED_EMAIL] now.\n"
    front = service.server(api, port=0)
    threading.Thread(target=front.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{front.server_port}"
    ask = lambda path, data=None: json.loads(urllib.request.urlopen(urllib.request.Request(at + path, data)).read())
    assert ask("/config")["top_k"] == 5 and ask("/query", b'{"question": "write to"}')[0]["chunk_text"] == "Write to [FILTERED_EMAIL] now."
    with pytest.raises(urllib.error.HTTPError, match="400"):
        ask("/query", b'{"question": "x", "top_k": -1}')
    front.shutdown()
    front.server_close()
    (tmp_path / "c.json").write_text(json.dumps(settings))
    (tmp_path / "b.txt").write_text("Mail c@d.org today.")
    run = lambda *a: command_line.main(["--config", str(tmp_path / "c.json"), *a], spark)
    assert [run("redact", str(tmp_path / "b.txt")), run("ingest", str(tmp_path / "b.txt")), run("query", "mail today"), run("redact", str(tmp_path / "none"))] == [0, 0, 0, 1]
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "Mail [FILTERED_EMAIL] today." and out[1].startswith("1 chunks") and json.loads(out[2])["chunk_text"] == "Mail [FILTERED_EMAIL] today."


def test_own_detector(spark):
    spans.register("ticket", lambda text, lang: spans.found(text, [spans.Rule("TICKET", 20, r"T-\d+")]))
    try:
        df = spark.createDataFrame([("See T-12\x02 and T-3.", "en")], "text string, lang string")
        assert retrieval.filtered(df).first().text == "See [FILTERED_TICKET]\x02 and [FILTERED_TICKET]."
    finally:
        spans.unregister("ticket")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
