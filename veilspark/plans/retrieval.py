"""From documents to redacted, embedded chunks, and from a question to hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import chunks, compare, spans
from veilspark.operators import vectors
from veilspark.sources import documents, metadata
from veilspark.sources.scratch import exists, names, through_storage

# Language codes and the codes they stand for; a few frequent words of each language.
ALIASES = {"nl": "nl", "nld": "nl", "dut": "nl", "fr": "fr", "fra": "fr", "fre": "fr", "en": "en", "eng": "en"}
FREQUENT = {"nl": "de het een van en is op te dat niet met", "fr": "le la les des et est une dans que pour du", "en": "the of and to in is that it was for with"}


def detected_language(text: Column) -> Column:
    """nl, fr or en by frequent words; nl for blank texts and for ties with it."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")

    def among(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    count = {k: among(v.split()) for k, v in FREQUENT.items()}
    return F.when((count["en"] > count["nl"]) & (count["en"] >= count["fr"]), "en").when((count["fr"] > count["nl"]) & (count["fr"] > count["en"]), "fr").otherwise("nl")


def resolved_language(hint: Column, text: Column | None = None) -> Column:
    """A hint's language; without a hint the text's, or nl where there is no text to ask. Unsupported hints are nl."""
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    empty = hint.isNull() | (F.trim(hint) == "")
    return F.when(empty, detected_language(text) if text is not None else F.lit("nl")).otherwise(F.coalesce(F.element_at(known, F.lower(F.trim(hint))), F.lit("nl")))


def model_found(text: Column, phone: Column, birth: Column, person: Column) -> Column:
    """Spans from a model's three answers, validated and trimmed (seq 6 to 8); null answers give none."""

    def tagged(rows: Column, seq: int) -> Column:
        trimmed = F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("found"), r["label"].alias("label")))
        return F.flatten(F.transform(trimmed, lambda r: F.transform(spans.trimmed(F.array(r)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), r["label"].alias("label"), F.lit(seq).alias("seq")))))

    by_phone = F.filter(compare.model_spans(phone, text, "$.spans", None), lambda r: (r["label"] == "PHONE") & F.regexp_replace(F.substring(text, r["start"] + 1, r["end"] - r["start"]), r"(?U)^\s+", "").startswith("+"))
    by_birth = F.concat(*(compare.model_spans(birth, text, f"$.{x}", x) for x in ("DATE_OF_BIRTH", "BIRTHPLACE", "ADDRESS")))
    names = F.flatten(F.transform(compare.persons(person), lambda p: compare.name_variants(p["given"], p["family"])))
    by_name = F.flatten(F.transform(names, lambda n: F.transform(compare.flexible_spans(text, n), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("PERSON").alias("label")))))
    return F.concat(*(F.coalesce(tagged(rows, seq), spans.none()) for rows, seq in ((by_phone, 6), (by_birth, 7), (by_name, 8))))


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as there are cores: a small file is one partition, and what follows costs more than a shuffle.

    A table of fewer partitions than cores holds at most spark.sql.files.maxPartitionBytes a core, which bounds the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", answers: tuple[str, str, str] | None = None, detail: bool = False, detectors: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text`` masked; with ``detail`` also the merged ``spans``. Null and empty texts pass unchanged.

    ``answers`` names columns with a model's answers for phones, birth data and persons.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    model = model_found(t, *(F.col(a) for a in answers)) if answers else None
    # spans stand in a column of their own: found once, used for masking and for the report
    out = spread(docs).withColumn("__spans", spans.merged(spans.all_spans(t, F.coalesce(F.col(lang), F.lit("nl")), model, detectors)))
    out = out.withColumn("__masked", F.when(F.size("__spans") > 0, spans.masked(F.col(text), F.col("__spans"))).otherwise(F.col(text)))
    kept = [F.col("__masked").alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*kept, *([F.col("__spans").alias("spans")] if detail else []))


def filter_all(text: str, language: str, spark: SparkSession) -> str:
    """One text, masked."""
    if not isinstance(text, str) or not text:
        raise ValueError("there is no text to mask")
    return filtered(spark.createDataFrame([(text, language)], "text string, lang string")).first()["text"]


def chunked(redacted: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """(document_id, source_path, chunk_index, chunk_text) of each chunk."""
    c = chunks.sentence_chunks(F.col("text"), F.col("lang"), size, overlap)
    return redacted.select("document_id", "source_path", F.posexplode(c).alias("chunk_index", "chunk_text"))


VECTORS = "vector_id bigint, embedding array<float>"


def stored(spark: SparkSession, index_path: str, metadata_path: str) -> DataFrame | None:
    """The vectors of all complete batches, or None if there is none yet. A batch is complete with its metadata."""
    if not exists(spark, index_path):
        return None
    found = metadata.batches(spark, metadata_path)
    if found:
        return spark.read.schema(VECTORS).parquet(*(metadata.batch_folder(index_path, b) for b in found))
    # an index that was not made by ingest()
    plain = not any(n.startswith("batch=") for n in names(spark, index_path))
    return spark.read.schema(VECTORS).parquet(index_path) if plain else None


def ingest(docs: DataFrame, index_path: str, metadata_path: str, size: int = 800, overlap: int = 120, embed: Callable[[Column], Column] = vectors.hashed_embedding, redacted_path: str | None = None, answers: tuple[str, str, str] | None = None) -> int:
    """Redacts, chunks, embeds and appends documents (document_id, source_path, text, lang); the number of chunks added.

    One writer at a time: ids go on from the stored number of vectors, and that number names the batch. The metadata comes
    last and makes the batch complete; an ingest that failed before that left nothing to be read, and the next one takes
    its number and its place.
    """
    spark = docs.sparkSession
    redacted = filtered(docs, answers=answers)
    if redacted_path:
        documents.write_sidecars(redacted, redacted_path)
    before = stored(spark, index_path, metadata_path)
    previous = before.count() if before is not None else 0
    # stored first: range partitioning reads its input twice
    numbered = vectors.with_dense_ids(through_storage(chunked(redacted, size, overlap)), ["source_path", "document_id", "chunk_index"], previous)
    here = metadata.batch_folder(index_path, previous)
    numbered.select("vector_id", embed(F.col("chunk_text")).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(here)
    added = spark.read.schema(VECTORS).parquet(here).count()
    if added:
        metadata.append(numbered, metadata_path, previous)
    return added


def query_index(spark: SparkSession, question: str, index_path: str, metadata_path: str, top_k: int = 5, embed: Callable[[Column], Column] = vectors.hashed_embedding) -> DataFrame:
    """The top_k hits of a question with their metadata, nearest first."""
    if not isinstance(question, str) or not question.strip():
        raise ValueError("there is no question to search for")
    index = stored(spark, index_path, metadata_path)
    if index is None:
        raise FileNotFoundError(f"nothing was taken in at {index_path} yet")
    q = spark.range(1).select(vectors.l2_normalised(embed(F.lit(question))).alias("q")).first()["q"]
    return vectors.with_metadata(vectors.nearest(index, q, top_k), metadata.read(spark, metadata_path)).orderBy("distance", "vector_id")
