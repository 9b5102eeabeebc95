"""Questions over a stored index as requests: chat, its PDF, evaluation. A table of questions is better asked as a table.

:meth:`Service.handle` answers a request by method, path and body, and :func:`serve` puts it behind the standard library's
HTTP server. Status codes: 400 for what can't be read, 404 and 405 for unknown places, 422 for a question that isn't one,
500 where there is no index, 502 where search fails, 503 where no model answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators import evaluation, evidence, fusion, lifecycle
from corpusloom.plans.search import searched
from corpusloom.runtime import stash
from corpusloom.sources import writers

PAGE = "<!doctype html><title>corpusloom</title><form method=post action=/chat><input name=question maxlength=2000><button>Ask</button></form>"


class RequestError(Exception):
    """A request that gets ``status`` and a reason."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class Service:
    """What requests are answered with: an index, the chunks' texts, a model, evaluation cases."""

    def __init__(self, spark: SparkSession, index_path: str, chunks: DataFrame, generate: Callable[..., str], cases: DataFrame | None = None, related: str = "judgments", **options):
        self.spark, self.index_path, self.chunks, self.generate, self.cases, self.related, self.options = spark, index_path, chunks, generate, cases, related, options
        self._index: lifecycle.StoredIndex | None = None

    def index(self) -> lifecycle.StoredIndex:
        if self._index is None:
            try:
                self._index = lifecycle.load_index(self.spark, self.index_path)
            except Exception as error:
                raise RequestError(500, "the index can't be loaded") from error
        return self._index

    def question(self, body: bytes) -> tuple[str, list[dict]]:
        """The checked question and the turns before it."""
        try:
            asked = json.loads(body)
            question, turns = asked["question"], asked.get("conversation_history") or []
            turns = [{"role": t["role"], "content": t["content"]} for t in turns]
        except (ValueError, KeyError, TypeError) as error:
            raise RequestError(422, "question is missing") from error
        if not isinstance(question, str) or not question.strip() or len(question) > fixed.QUESTION_MAX_CHARS or any(t["role"] not in ("user", "assistant") for t in turns):
            raise RequestError(422, f"question must have 1 to {fixed.QUESTION_MAX_CHARS} characters, turns a user or an assistant")
        return question.strip(), [t for t in turns if t["content"].strip()]

    def chat(self, question: str, turns: list[dict]) -> dict:
        index = self.index()
        asked = self.spark.createDataFrame([(0, question, question)], "query_id long, text string, question string")
        try:
            lists = stash(searched(index, asked, each=True, **self.options), "lists")
            hits = fusion.federate(lists).withColumnRenamed("place", "rank0")
            told, found = evidence.answered(asked.drop("text"), hits, self.chunks, self.generate, history=turns)
            related = fusion.related(lists, self.related).join(self.chunks.withColumnRenamed("chunk_id", "id").drop("category"), "id")
            row = evidence.responses(told, found, related).first()
        except RequestError:
            raise
        except Exception as error:
            if evidence.NO_MODEL in str(error):
                raise RequestError(503, "no model gave an answer") from error
            raise RequestError(502, "the question couldn't be answered") from error
        return row.asDict(recursive=True)

    def evaluate(self, ks: str) -> dict:
        """Metrics of the cases by category, and their means, from one search of all cases."""
        try:
            wanted = tuple(sorted({int(k) for k in ks.split(",") if k.strip()}))
        except ValueError as error:
            raise RequestError(400, "k must be whole numbers with commas between") from error
        if not wanted or wanted[0] <= 0:
            raise RequestError(400, "every k must be greater than zero")
        if self.cases is None:
            raise RequestError(500, "there are no cases")
        cases = self.cases.select(F.xxhash64("category", "query").alias("query_id"), F.col("query").alias("text"), "category", "relevant_ids")
        found = searched(self.index(), cases.select("query_id", "text"), max(wanted), each=True, **self.options).join(cases.select("query_id", F.col("category").alias("own")), "query_id").where("category = own")
        relevant = cases.select("query_id", F.explode("relevant_ids").alias("id"))
        per_query = evaluation.metrics(cases, found, relevant, wanted).join(cases.select("query_id", "category"), "query_id")
        by_category = evaluation.macro(per_query, "category")
        categories: dict[str, dict] = {}
        for row in by_category.collect():
            categories.setdefault(row["category"], {})[str(row["k"])] = {m: row[m] for m in ("precision", "recall", "mrr", "map")}
        overall = {str(r["k"]): {m: r[m] for m in ("precision", "recall", "mrr", "map")} for r in evaluation.overall(by_category).collect()}
        return {"k_values": list(wanted), "categories": categories, "overall_macro": overall}

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
        """(status, content type, content)"""
        place = urlsplit(path)
        routes = {("GET", "/"): self._page, ("GET", "/health"): self._health, ("POST", "/chat"): self._chat, ("POST", "/chat/pdf"): self._pdf, ("GET", "/eval"): self._eval}
        try:
            if (method, place.path) not in routes:
                raise RequestError(405 if any(p == place.path for _, p in routes) else 404, "unknown place")
            return (200, *routes[method, place.path](parse_qs(place.query), body))
        except RequestError as error:
            return error.status, "application/json", json.dumps({"detail": str(error)}).encode()

    def _page(self, query: dict, body: bytes) -> tuple[str, bytes]:
        return "text/html; charset=utf-8", PAGE.encode()

    def _health(self, query: dict, body: bytes) -> tuple[str, bytes]:
        return "application/json", json.dumps({"status": "ok", "index_loaded": self._index is not None}).encode()

    def _chat(self, query: dict, body: bytes) -> tuple[str, bytes]:
        return "application/json", json.dumps(self.chat(*self.question(body)), ensure_ascii=False).encode()

    def _pdf(self, query: dict, body: bytes) -> tuple[str, bytes]:
        return "application/pdf", writers.render_pdf(writers.report_lines(self.chat(*self.question(body))))

    def _eval(self, query: dict, body: bytes) -> tuple[str, bytes]:
        return "application/json", json.dumps(self.evaluate(query.get("k", ["1,3,5,10"])[0])).encode()


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that answers with ``service``; the caller runs ``serve_forever`` and ``shutdown``."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, content = service.handle(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
