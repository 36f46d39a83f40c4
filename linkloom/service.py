"""A small JSON service over the URL analysis.

POST /analyze {"url", "fetch_metadata"?, "timeout"?}, POST /analyze/batch {"urls", "fetch_metadata"?, "max_concurrency"?}, GET /health.
Requests are bounded: URLs of 1 to 4,096 characters, batches of 1 to 100, timeouts of 0.5 to 30 seconds, 1 to 25 pages at once.
"""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from linkloom.functions import pages, url
from linkloom.operators import models
from linkloom.sources.io import Fetcher, fetch_pages, http_fetch

MAX_URL, MAX_BATCH = 4096, 100


class BadRequest(ValueError):
    pass


def _number(payload: dict, name: str, default: float, least: float, most: float) -> float:
    value = payload.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most:
        raise BadRequest(f"{name}: a number from {least} to {most}")
    return value


class Service:
    """What the routes answer, without the network."""

    def __init__(self, spark: SparkSession, fetch: Fetcher = http_fetch):
        self.spark, self.fetch, self.begin = spark, fetch, time.time()
        self.model = models.url_model(spark)

    def health(self) -> dict:
        return {"status": "healthy", "model_loaded": True, "uptime_seconds": round(time.time() - self.begin, 2)}

    def _results(self, urls: list[str], metadata: bool, timeout: float, at_once: int) -> list[dict]:
        for u in urls:
            if not isinstance(u, str) or not 1 <= len(u) <= MAX_URL:
                raise BadRequest(f"url: a text of 1 to {MAX_URL} characters")
        given = self.spark.createDataFrame(list(enumerate(urls)), "place int, url string")
        found = url.analyze(given, score=models.url_scorer(self.model)).orderBy("place")
        rows = [r.asDict(recursive=True) for r in found.collect()]  # at most MAX_BATCH
        if metadata:
            fetched = fetch_pages(given.select("url").distinct().coalesce(1), self.fetch, timeout, at_once)
            # A failed fetch has no page, and its own error.
            heads = {r["url"]: r for r in pages.enrich(fetched.drop("error")).select("url", "title", "description", "favicon_url").collect()}
            got = {r["url"]: {k: r[k] for k in ("final_url", "status_code", "content_type", "response_time_ms", "redirect_chain", "error")} for r in fetched.collect()}
            for row in rows:
                row["metadata"] = got[row["url"]] | {k: heads[row["url"]][k] for k in ("title", "description", "favicon_url")}
        return [{k: v for k, v in row.items() if k != "place"} for row in rows]

    def analyze(self, payload: dict) -> dict:
        return self._results([payload.get("url")], bool(payload.get("fetch_metadata")), _number(payload, "timeout", 5.0, 0.5, 30.0), 1)[0]

    def batch(self, payload: dict) -> dict:
        begin, urls = time.perf_counter(), payload.get("urls")
        if not isinstance(urls, list) or not 1 <= len(urls) <= MAX_BATCH:
            raise BadRequest(f"urls: a list of 1 to {MAX_BATCH}")
        rows = self._results(urls, bool(payload.get("fetch_metadata")), 5.0, int(_number(payload, "max_concurrency", 10, 1, 25)))
        good = sum(r["is_valid"] and r["error"] is None for r in rows)
        return {"total_requested": len(urls), "total_successful": good, "total_failed": len(rows) - good, "duration_ms": round((time.perf_counter() - begin) * 1000, 2), "results": rows}


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """Listens once its serve_forever is called."""
    service = Service(spark)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(200, service.health()) if self.path == "/health" else self.answer(404, {"error": "no such path"})

        def do_POST(self) -> None:
            route = {"/analyze": service.analyze, "/analyze/batch": service.batch}.get(self.path)
            if route is None:
                return self.answer(404, {"error": "no such path"})
            try:
                size = min(int(self.headers.get("Content-Length", 0)), 2 * MAX_URL * MAX_BATCH)
                payload = json.loads(self.rfile.read(size))
                if not isinstance(payload, dict):
                    raise BadRequest("an object is expected")
                self.answer(200, route(payload))
            except ValueError as e:  # bad JSON, bad values
                self.answer(422, {"error": str(e)})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
