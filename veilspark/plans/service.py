"""The operations of a server, with its checks, on a session and settings; and a small HTTP front for them."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.plans import retrieval
from veilspark.sources import documents
from veilspark.sources.scratch import exists


class Refused(Exception):
    """A request that is not carried out: its HTTP status and why."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Service:
    def __init__(self, spark: SparkSession, settings: dict):
        self.spark, self.settings = spark, settings

    def config(self) -> dict:
        return self.settings

    def _language(self, hint: str | None, text: str) -> str:
        """The hint's language, or the text's own without one."""
        row = self.spark.createDataFrame([(hint, text)], "hint string, text string")
        return row.select(retrieval.resolved_language(F.col("hint"), F.col("text")).alias("lang")).first()["lang"]

    @staticmethod
    def _text(request: dict) -> str:
        text = request.get("text")
        if not isinstance(text, str) or not text:
            raise Refused(400, "text must be a string with something in it")
        return text

    def redact(self, request: dict) -> dict:
        """text, language_hint -> the text masked."""
        text = self._text(request)
        lang = self._language(request.get("language_hint"), text)
        return {"status": "ok", "language": lang, "filtered_preview": retrieval.filter_all(text, lang, self.spark)}

    def ingest(self, request: dict) -> dict:
        """text, source_label, language_hint -> the text taken in, and its sidecar written."""
        text = self._text(request)
        label = request.get("source_label") or "api"
        lang = self._language(request.get("language_hint"), text)
        s = self.settings
        row = self.spark.createDataFrame([(label, text, lang)], "source_path string, text string, lang string").withColumn("document_id", documents.document_id(F.col("source_path")))
        try:
            added = retrieval.ingest(row, s["index_path"], s["metadata_path"], int(s["chunk_size"]), int(s["chunk_overlap"]), redacted_path=s["redacted_path"])
        except Exception as e:
            raise Refused(500, f"the text was not taken in: {e}") from e
        return {"status": "ok", "language": lang, "ingested_chunks": added, "index_path": s["index_path"], "metadata_path": s["metadata_path"], "redacted_path": s["redacted_path"], "source_label": label}

    def upload(self, name: str, content: bytes, mode: str = "redact", source_label: str = "upload", language_hint: str | None = None) -> dict:
        """A docx or pdf file, saved and then redacted or taken in."""
        try:
            path = documents.saved_upload(self.spark, self.settings["upload_path"], name, content)
            text = documents.extracted(path, content)
        except Exception as e:
            raise Refused(400, str(e)) from e
        if mode.lower() not in ("redact", "ingest"):
            raise Refused(400, "mode is redact or ingest")
        out = getattr(self, mode.lower())({"text": text, "source_label": source_label or name, "language_hint": language_hint})
        return {**out, "mode": mode.lower(), "source_label": source_label or name}

    def query(self, request: dict) -> list[dict]:
        """question, top_k -> the nearest chunks."""
        top_k = request.get("top_k", self.settings["top_k"])
        if not isinstance(top_k, int) or top_k <= 0:
            raise Refused(400, "top_k is a whole number above 0")
        try:
            hits = retrieval.query_index(self.spark, request.get("question"), self.settings["index_path"], self.settings["metadata_path"], top_k).collect()
        except FileNotFoundError as e:
            raise Refused(404, str(e)) from e
        except Exception as e:
            raise Refused(500, f"the search failed: {e}") from e
        return [h.asDict() for h in hits]

    def redacted(self, basename: str) -> str:
        """The text of a sidecar."""
        try:
            found = documents.read_sidecar(self.spark, self.settings["redacted_path"], basename)
        except ValueError as e:
            raise Refused(400, str(e)) from e
        except Exception as e:  # Spark's own error for a path that isn't there
            raise Refused(404, "there is no such sidecar") from e
        return found.first()["value"]

    def tools(self) -> dict[str, Callable]:
        """The operations that agents call. Unlike requests they don't detect a language: without a hint it is nl."""

        def redact_text(text: str, language_hint: str | None = None) -> dict:
            return self.redact({"text": text, "language_hint": language_hint or "nl"})

        def ingest_file(path: str, language_hint: str | None = None) -> dict:
            if not exists(self.spark, path):
                raise Refused(404, f"{path} isn't there")
            row = documents.read_documents(self.spark, path).first()
            return self.ingest({"text": row["text"], "source_label": row["source_path"], "language_hint": language_hint or "nl"})

        def query_corpus(question: str, top_k: int | None = None) -> list[dict]:
            return self.query({"question": question, "top_k": top_k or self.settings["top_k"]})

        return {"get_config": self.config, "redact_text": redact_text, "ingest_file": ingest_file, "query_corpus": query_corpus}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /config and /redacted/<name>; POST /redact, /ingest and /query with JSON; POST /upload?filename=...&mode=... with the file's bytes."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, work: Callable[[], object]) -> None:
            try:
                status, body = 200, work()
            except Refused as e:
                status, body = e.status, {"detail": str(e)}
            except (ValueError, TypeError) as e:
                status, body = 400, {"detail": str(e)}
            raw = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            path = unquote(urlsplit(self.path).path)
            if path == "/config":
                self._answer(service.config)
            elif path.startswith("/redacted/"):
                self._answer(lambda: service.redacted(path.removeprefix("/redacted/")))
            else:
                self._answer(self._unknown)

        def do_POST(self) -> None:
            at, raw = urlsplit(self.path), self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked = {k: v[0] for k, v in parse_qs(at.query).items()}
            if at.path == "/upload":
                self._answer(lambda: service.upload(asked.pop("filename", "upload"), raw, **asked))
            elif at.path in ("/redact", "/ingest", "/query"):
                self._answer(lambda: getattr(service, at.path[1:])(json.loads(raw)))
            else:
                self._answer(self._unknown)

        def _unknown(self) -> None:
            raise Refused(404, "there is nothing at this path")

        def log_message(self, *args) -> None:
            """Requests hold raw personal data; nothing is logged."""

    return ThreadingHTTPServer((host, port), Handler)
