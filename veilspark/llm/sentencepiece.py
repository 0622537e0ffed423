"""SentencePiece encoding and decoding through the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores (unigram) or merge ranks (BPE) and byte
fallback are rebuilt as a tokenizers pipeline, which encodes batches of whole texts on several threads, and its decoder
turns the ids back into texts. Parity with the sentencepiece library is verified for every whole text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that are encoded at once, which bounds the memory of a batch.
CHARS = 300_000
#: A marker after something else, and sections of a text, of some 1,000 characters, that start at one.
CROSSING, SECTION = re.compile(f"[^{META}]{META}"), re.compile(f"(?s).{{1000}}.*?[^{META}](?={META})|.+")


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at += 1
            if byte < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unknown: int = 0


def parsed(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding and decoding need."""
    m = Model()
    for number, _, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 24:
                    m.suffix = bool(v)
        elif number == 3:
            for n, _, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    m.unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose union is a piece, best score of the union first."""
    known = {p: k for k, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for k, (p, score, kind) in enumerate(m.pieces):
        if kind == NORMAL:
            found += [(-score, k, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
    return [(a, b) for _, _, a, b in sorted(found)]


def tokenizer_of(m: Model):
    """The same model as a tokenizers pipeline. Raises ValueError for what it cannot reproduce."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind}")
    if m.suffix:
        raise ValueError("white space as suffix")
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
    else:
        # a whole text is one word to the model: no store of words would ever be hit
        core = models.BPE({p: k for k, (p, _, _) in enumerate(m.pieces)}, merges_of(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(META if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", META))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    own = [p for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens([AddedToken(p, normalized=True) for p in own])
    end = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return t


def decoder_of(m: Model):
    """The pipeline's decoder over pieces whose markers are spaces already, which spares it a pattern for every piece.

    The space that a dummy prefix leaves in front is left to decode(): the decoder would copy the text by characters for it.
    """
    from tokenizers import Tokenizer, decoders, models

    shown = [" \u2047 " if kind == UNKNOWN else p.replace(META, " ") for p, _, kind in m.pieces]
    t = Tokenizer(models.WordLevel({p: k for k, p in enumerate(shown)}, unk_token=shown[m.unknown]))
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return t


class Pipeline:
    """A model file's encoder, decoder and sentencepiece processor."""

    def __init__(self, data: bytes):
        import sentencepiece

        m = parsed(data)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.encoder, self.decoder = tokenizer_of(m), decoder_of(m)
        self.control = frozenset(k for k, (_, _, kind) in enumerate(m.pieces) if kind == CONTROL)
        # a normaliser that only sets markers is a replacement of strings, done before the texts are handed over
        self.marks = m.escape and m.dummy_prefix and not m.charsmap and not m.squeeze and not any(kind == USER_DEFINED for _, _, kind in m.pieces)
        if self.marks:
            self.encoder.normalizer = None
        self.prefix = m.dummy_prefix
        # no merge crosses the start of a run of markers if no piece does, so that a text may be handed over in sections,
        # whose queues of merges are short
        self.sections = self.marks and m.kind == BPE and any(p == META for p, _, _ in m.pieces) and not any(CROSSING.search(p) for p, _, _ in m.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        given = [META + t.replace(" ", META) if t else "" for t in texts] if self.marks else texts
        if self.sections:
            given = [SECTION.findall(t) for t in given]
        return [e.ids for e in self.encoder.encode_batch_fast(given, is_pretokenized=self.sections, add_special_tokens=False)]

    def decode(self, ids: list[list[int]], clean: bool = False) -> list[str]:
        """``clean``: no control piece is known to be among the ids."""
        shown = (x if clean or self.control.isdisjoint(x) else [i for i in x if i not in self.control] for x in ids)
        # one by one: decoding is short, and the threads of a batch would spend as much again on waiting for it
        texts = (self.decoder.decode(x, skip_special_tokens=False) for x in shown)
        return [t.removeprefix(" ") for t in texts] if self.prefix else list(texts)

    def parity(self, texts: list[str], ids: Sequence[Sequence[int]]) -> list[bool]:
        return [array("i", x).tobytes() == self.other.encode(t, return_type="numpy").tobytes() for t, x in zip(texts, ids)]


@lru_cache(maxsize=4)
def loaded(path: str) -> Pipeline:
    """The pipeline of a file, once per process."""
    with open(path, "rb") as f:
        return Pipeline(f.read())


def tokenized(docs: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids, exact (the decoded ids give the text again) and parity (sentencepiece gives these ids).

    Both verdicts are on the whole text. One row for each row of ``docs``, repeated ones and null ids included; a null text
    is encoded as an empty one, to no ids, and an empty table gives an empty result. ``model`` is a path on the driver; the
    file (some hundred kB) is sent to the executors. Texts are encoded whole, a bounded number at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = os.path.basename(model)
    spark.sparkContext.addFile(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        pipeline = loaded(SparkFiles.get(name))
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHARS):
                    size += len(texts[upto])
                    upto += 1
                part = texts[at:upto]
                ids = pipeline.encode(part)
                # as arrays the ids are compared and handed over without an object for each
                arrays = [array("i", x) for x in ids]
                flat, n = np.frombuffer(b"".join(arrays), np.int32), np.array([len(x) for x in ids])
                clean = not np.isin(flat, list(pipeline.control)).any()
                exact = [x == y for x, y in zip(pipeline.decode(ids, clean), part)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, upto - at), pa.array(n, pa.int64()), lists, pa.array(exact), pa.array(pipeline.parity(part, arrays))], ["doc_id", "n_tokens", "ids", "exact", "parity"])
                at = upto

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean, parity boolean")
