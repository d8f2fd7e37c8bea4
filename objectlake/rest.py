"""The store over HTTP: JSON in and out; requests run side by side."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from objectlake.functions.names import parse_id
from objectlake.schema import BULK_BYTES, InvalidRequest, LakeError, NoClass
from objectlake.store import ObjectStore

#: The request header that names the project; absent or blank is the default project.
PROJECT_HEADER = "X-Project"


class Api:
    """Answers requests with a status and a JSON value, None for no body."""

    def __init__(self, store: ObjectStore) -> None:
        self.store = store

    def handle(self, method: str, target: str, body: str = "", project: str | None = None) -> tuple[int, object]:
        try:
            return self._route(method, target, body, (project or "").strip())
        except LakeError as error:
            return error.status, {"error": str(error)}
        except Exception as error:  # a request must not end the server
            return 500, {"error": f"internal error: {error}"}

    def _route(self, method: str, target: str, body: str, project: str) -> tuple[int, object]:
        url, store = urlsplit(target), self.store
        parts = [unquote(p) for p in url.path.strip("/").split("/")]
        params = parse_qs(url.query, keep_blank_values=True)
        match (method, *parts):
            case ("GET", "v1", "health"):
                return 200, {"status": "ok"}
            case ("GET", "v1", "stats"):
                return 200, store.stats()
            case ("GET", "v1", "projects"):
                return 200, {"projects": store.list_projects()}
            case ("POST", "v1", "classes"):
                name = self._name(body)
                store.create_class(name, project)
                return 201, {"name": name, "project": project}
            case ("GET", "v1", "classes"):
                return 200, {"classes": store.list_classes(project), "project": project}
            case ("GET", "v1", "classes", name):
                if not store.class_exists(project, name):
                    raise NoClass(f"no class {name}")
                return 200, {"name": name, "project": project}
            case ("DELETE", "v1", "classes", name):
                store.drop_class(name, project)
                return 204, None
            case ("POST", "v1", "classes", name, "objects"):
                return 201, store.create(name, body, project)
            case ("POST", "v1", "classes", name, "objects", "bulk"):
                ids = store.create_bulk(name, body, project)
                return 201, {"ids": ids, "count": len(ids)}
            case ("GET", "v1", "classes", name, "objects"):
                return 200, store.find(name, params, project)
            case ("GET", "v1", "classes", name, "objects", id_):
                return 200, store.get(name, parse_id(id_), project)
            case ("PUT", "v1", "classes", name, "objects", id_):
                return 200, store.put(name, parse_id(id_), body, project)
            case ("DELETE", "v1", "classes", name, "objects", id_):
                store.delete(name, parse_id(id_), project)
                return 204, None
        return 404, {"error": "not found"}

    @staticmethod
    def _name(body: str) -> str:
        try:
            value = json.loads(body)
        except ValueError as error:
            raise InvalidRequest(f"invalid JSON: {error}") from None
        name = value.get("name") if isinstance(value, dict) else None
        if not isinstance(name, str) or not name:
            raise InvalidRequest("a class needs a name, as text")
        return name


class Server(ThreadingHTTPServer):
    """Looks after the store from time to time, beside the requests."""

    def __init__(self, address: tuple[str, int], handler: type, store: ObjectStore) -> None:
        super().__init__(address, handler)
        self.store, self.busy, self.looked = store, None, time.time()

    def service_actions(self) -> None:
        if time.time() - self.looked >= 1 and not (self.busy and self.busy.is_alive()):
            self.looked = time.time()
            if self.store.checkpoint_due():
                self.busy = threading.Thread(target=self.store.maintain, daemon=True)
                self.busy.start()


def server(store: ObjectStore, host: str = "127.0.0.1", port: int = 8080) -> Server:
    """A server to ``serve_forever``; ``shutdown`` lets running requests end."""
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(min(int(self.headers.get("Content-Length") or 0), BULK_BYTES + 1))
            status, value = api.handle(self.command, self.path, body.decode("utf-8", "replace"), self.headers.get(PROJECT_HEADER))
            out = b"" if value is None else json.dumps(value, ensure_ascii=False).encode() + b"\n"
            self.send_response(status)
            if value is not None:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *_) -> None:
            pass

    return Server((host, port), Handler, store)
