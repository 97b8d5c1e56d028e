"""The engine over HTTP, by the standard library alone: JSON in and out, 400 for bad requests, 404 for what isn't there."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from tablewright.plans.engine import Engine
from tablewright.plans.errors import BadRequest, NotFound

PREFIX = "/api/v1"


def answer(engine: Engine, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
    """(status, result) of one request."""
    try:
        return _answer(engine, method, path, body or {})
    except BadRequest as e:
        return 400, {"detail": str(e)}
    except NotFound as e:
        return 404, {"detail": str(e)}
    except Exception as e:  # what the engine didn't foresee is told, not hidden
        return 500, {"detail": f"{type(e).__name__}: {e}"}


def _answer(engine: Engine, method: str, path: str, body: dict) -> tuple[int, object]:
    parts = [unquote(p) for p in path.removeprefix(PREFIX).split("/") if p]
    if method == "GET" and path == "/healthz":
        return 200, engine.health()
    if method == "GET" and path == "/readyz":
        ready = engine.readiness()
        return (200 if ready["status"] == "ok" else 503), ready
    if not path.startswith(PREFIX + "/"):
        raise NotFound(f"no route {path}")
    if method == "GET" and parts[:1] == ["datasets"] and len(parts) <= 4:
        return 200, (engine.datasets, engine.dataset, engine.versions, engine.version)[len(parts) - 1](*parts[1:])
    if method == "GET" and parts[:2] == ["analysis", "cache"] and len(parts) == 3:
        if (found := engine.cached(parts[2])) is None:
            raise NotFound("no such result, or its time is over")
        return 200, found
    posts: dict[tuple[str, ...], Callable] = {("analysis", "run"): engine.analyse, ("analysis", "preview"): engine.preview, ("plots",): engine.plot, ("quality", "basic"): engine.quality}
    if method == "POST" and (call := posts.get(tuple(parts))):
        wanted = {"dataset", "version", "variant", *({"operations"} if call in (engine.analyse, engine.plot) else ()), *({"filters"} if call == engine.analyse else ())}
        lacking = [k for k in ("dataset", "version", *(["operations"] if "operations" in wanted else [])) if k not in body]
        if lacking:
            raise BadRequest(f"the request lacks {', '.join(lacking)}")
        return 200, call(**{k: v for k, v in body.items() if k in wanted})
    raise NotFound(f"no route {method} {path}")


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8080, sweep_seconds: float | None = 300) -> ThreadingHTTPServer:
    """A server that isn't started yet; while it runs, results whose time is over are dropped every ``sweep_seconds``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
                status, result = answer(engine, method, urlsplit(self.path).path, body) if isinstance(body, dict) else (400, {"detail": "a request is a JSON object"})
            except ValueError:
                status, result = 400, {"detail": "the request is no JSON"}
            out = json.dumps(result, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *_) -> None:
            pass

    class Server(ThreadingHTTPServer):
        def server_close(self) -> None:
            over.set()
            super().server_close()

    over = threading.Event()

    def sweep() -> None:
        while not over.wait(sweep_seconds):
            engine.sweep()

    if sweep_seconds:
        threading.Thread(target=sweep, daemon=True).start()
    return Server((host, port), Handler)
