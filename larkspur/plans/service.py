"""The calls a service offers: ask, health, recent queries, grounding statistics. Answers are logged to two
append-only tables; a log that cannot be written does not lose the answer."""

from __future__ import annotations

import datetime as dt
import http.server
import json
import logging
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur import schemas
from larkspur.operators import lifecycle
from larkspur.plans.answer import Answerer
from larkspur.sources.store import exists

log = logging.getLogger(__name__)


class AuditLog:
    """``queries`` and ``citations`` below ``root``; filters are stored only if there are any."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def record(self, answer: dict, mode: str, top_k: int, wanted: dict | None = None) -> str:
        key = uuid.uuid4().hex
        row = (
            key, answer["question"], answer["answer"], mode, top_k, json.dumps(wanted, sort_keys=True) if wanted else None, answer.get("model"), float(answer.get("latency_ms") or 0),
            answer.get("input_tokens"), answer.get("output_tokens"), bool(answer["is_grounded"]), list(answer["ungrounded_figures"]), dt.datetime.now(dt.timezone.utc),
        )
        self.spark.createDataFrame([row], schemas.QUERY_LOG).write.mode("append").parquet(f"{self.root}/queries")
        cites = [(key, n, c["chunk_id"], c["citation"], c["excerpt"]) for n, c in enumerate(answer["citations"], 1)]
        if cites:
            self.spark.createDataFrame(cites, schemas.CITATION_LOG).write.mode("append").parquet(f"{self.root}/citations")
        return key

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def queries(self) -> DataFrame:
        return self._read("queries", schemas.QUERY_LOG)

    def citations(self) -> DataFrame:
        return self._read("citations", schemas.CITATION_LOG)


class Service:
    def __init__(self, answerer: Answerer | None, audit: AuditLog):
        self.answerer, self.audit = answerer, audit

    def health(self) -> dict:
        return {"status": "ok" if self.answerer else "loading", "logged": exists(self.audit.spark, f"{self.audit.root}/queries")}

    def ask(self, question: str, top_k: int = 5, mode: str = "hybrid", passages: bool = False, wanted: dict | None = None) -> dict:
        if self.answerer is None:
            raise RuntimeError("no index is loaded yet")
        answer = self.answerer.ask(question, top_k, mode, wanted)
        try:
            answer["query_id"] = self.audit.record(answer, mode, top_k, wanted)
        except Exception:  # the answer was paid for
            log.exception("the answer could not be logged")
            answer["query_id"] = None
        if not passages:
            answer.pop("passages", None)
        return answer

    def recent(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in lifecycle.recent_queries(self.audit.queries(), limit).collect()]

    def stats(self) -> dict:
        return lifecycle.grounding_stats(self.audit.queries()).first().asDict()


def http_server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> http.server.ThreadingHTTPServer:
    """``GET /health``, ``GET /queries?limit=``, ``GET /stats`` and ``POST /query`` (question, top_k, mode, filters,
    include_passages) in JSON. What a request gets wrong is 422, what is not loaded yet 503."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def _reply(self, status: int, body) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _run(self, call) -> None:
            try:
                self._reply(200, call())
            except (KeyError, TypeError, ValueError) as e:
                self._reply(422, {"detail": str(e)})
            except RuntimeError as e:
                self._reply(503, {"detail": str(e)})

        def do_GET(self) -> None:
            url = urllib.parse.urlsplit(self.path)
            limit = urllib.parse.parse_qs(url.query).get("limit", ["20"])[0]
            calls = {"/health": service.health, "/stats": service.stats, "/queries": lambda: service.recent(int(limit))}
            if url.path in calls:
                self._run(calls[url.path])
            else:
                self._reply(404, {"detail": "no such call"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self._reply(404, {"detail": "no such call"})
            raw = self.rfile.read(int(self.headers.get("Content-Length", 0)))

            def call() -> dict:
                q = json.loads(raw)
                return service.ask(q["question"], q.get("top_k", 5), q.get("mode", "hybrid"), bool(q.get("include_passages")), q.get("filters"))

            self._run(call)

        def log_message(self, *args) -> None:
            log.debug(*args)

    return http.server.ThreadingHTTPServer((host, port), Handler)
