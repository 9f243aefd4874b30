"""An HTTP endpoint for queries: GET or POST /sparql?query=..., a form at /."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from triplane.plans.ast import QueryError
from triplane.results import xml_chunks
from triplane.sources.base import TripleSource

LONGEST_QUERY = 32_768
_FORM = b'<!DOCTYPE html><title>Query</title><form action="/sparql"><textarea name="query" rows="20" cols="100"></textarea><br><button>Run</button></form>'


def handler_for(source: TripleSource) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: bytes, kind: str = "text/plain; charset=utf-8") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def query(self, text: str | None) -> None:
            if not text:
                return self.answer(400, b"no query given")
            if len(text.encode()) > LONGEST_QUERY:
                return self.answer(400, b"the query is too long")
            try:
                chunks = xml_chunks(source, text)
            except QueryError as error:
                return self.answer(400, str(error).encode())
            except Exception as error:
                return self.answer(500, str(error)[:500].encode())
            self.send_response(200)
            self.send_header("Content-Type", "application/sparql-results+xml")
            self.send_header("Connection", "close")
            self.end_headers()
            for chunk in chunks:
                self.wfile.write(chunk.encode())
            self.close_connection = True

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/":
                self.answer(200, _FORM, "text/html; charset=utf-8")
            elif url.path == "/sparql":
                self.query(parse_qs(url.query).get("query", [None])[0])
            else:
                self.answer(404, b"not found")

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if url.path != "/sparql":
                return self.answer(404, b"not found")
            if size > 4 * LONGEST_QUERY:
                return self.answer(400, b"the query is too long")
            body = self.rfile.read(size).decode()
            raw = self.headers.get("Content-Type", "").startswith("application/sparql-query")
            self.query(body if raw else (parse_qs(body).get("query") or parse_qs(url.query).get("query") or [None])[0])

        def other(self) -> None:
            self.answer(405, b"only GET and POST")

        do_PUT = do_DELETE = do_PATCH = do_HEAD = other

        def log_message(self, *args) -> None:
            if getattr(self.server, "verbose", False):
                super().log_message(*args)

    return Handler


def serve(source: TripleSource, host: str = "127.0.0.1", port: int = 8000, verbose: bool = False) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; port 0 picks a free one."""
    server = ThreadingHTTPServer((host, port), handler_for(source))
    server.verbose = verbose
    return server
