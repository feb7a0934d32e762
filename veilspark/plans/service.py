"""A small HTTP service over office files: POST /redact?name=FILE with the file as body gives a job id;
GET /jobs/ID, /jobs/ID/download and /jobs/ID/mapping follow it. Jobs run one after the other.

Status codes: 400 for files that are no .docx, 404 for unknown jobs and paths, 409 before a job is done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from ..config import Settings
from ..operators import finders, rewrite
from .office import redact_files


class Jobs:
    """States: queued, running, done, verify_failed, failed. ``folder``: one that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, models: Sequence[finders.Finder] = ()):
        self.spark, self.settings, self.models = spark, settings, models
        self.folder = Path(folder)
        self.states: dict[str, dict] = {}
        self.worker = ThreadPoolExecutor(max_workers=1)

    def submit(self, name: str, content: bytes) -> str:
        job = uuid.uuid4().hex[:12]
        place = self.folder / job
        place.mkdir(parents=True)
        (place / "input.docx").write_bytes(content)
        self.states[job] = {"status": "queued", "file": name}
        self.worker.submit(self._run, job, place)
        return job

    def _run(self, job: str, place: Path) -> None:
        state = self.states[job]
        state["status"] = "running"
        try:
            result, files = redact_files(self.spark, str(place / "input.docx"), self.settings, self.models)
            state["summary"] = [r.asDict() for r in result.summary().collect()]  # one file, one row
            made = files.first()
            if made is not None:
                (place / "output.docx").write_bytes(bytes(made.content))
                rows = rewrite.mapping(result.entities).orderBy("entity_id").toPandas()
                rows.drop(columns="doc_id").to_csv(place / "mapping.csv", index=False)
            state["status"] = "verify_failed" if made is None else "done"
        except Exception as error:  # noqa: BLE001 - a job's failure is its answer, the service goes on
            state.update(status="failed", error=str(error)[:500])

    def result(self, job: str, what: str) -> bytes | None:
        if self.states[job]["status"] != "done":
            return None
        return (self.folder / job / {"download": "output.docx", "mapping": "mapping.csv"}[what]).read_bytes()


def serve(jobs: Jobs, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """The server, not yet started: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: bytes | dict, kind: str = "application/json") -> None:
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            url = urlparse(self.path)
            name = parse_qs(url.query).get("name", [""])[0]
            content = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if url.path != "/redact":
                self.answer(404, {"error": "no such path"})
            elif not name.lower().endswith(".docx"):
                self.answer(400, {"error": "send a .docx file and its name"})
            else:
                self.answer(200, {"job_id": jobs.submit(name, content)})

        def do_GET(self) -> None:
            parts = urlparse(self.path).path.strip("/").split("/")
            if parts[0] != "jobs" or len(parts) not in (2, 3) or parts[1] not in jobs.states or parts[2:] not in ([], ["download"], ["mapping"]):
                self.answer(404, {"error": "no such job or path"})
            elif len(parts) == 2:
                self.answer(200, jobs.states[parts[1]])
            elif (body := jobs.result(parts[1], parts[2])) is None:
                self.answer(409, {"error": "the job is not done"})
            else:
                self.answer(200, body, "application/octet-stream" if parts[2] == "download" else "text/csv")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
