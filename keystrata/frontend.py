"""Front ends: result formats, seed files, a line shell, and a read-only HTTP endpoint."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from keystrata.engine import Engine, Result
from keystrata.errors import SqlError
from keystrata.sql.parser import Select, parse


#: Rows that a front end fetches; what it leaves out is counted and said.
ROW_LIMIT = 10_000


def _fetched(result: Result, limit: int) -> tuple[list[tuple], bool]:
    if result.frame is None:
        return [], False
    rows = [tuple(r) for r in result.frame.take(limit + 1)]
    if len(rows) <= limit:
        result.affected = len(rows)
    return rows[:limit], len(rows) > limit


def to_json(result: Result, limit: int = ROW_LIMIT) -> str:
    rows, more = _fetched(result, limit)
    told = {"columns": result.columns, "rows": rows, "rows_affected": result.rows_affected, "message": result.message}
    return json.dumps(told | ({"truncated": True} if more else {}), ensure_ascii=False)


def to_text(result: Result, limit: int = ROW_LIMIT) -> str:
    rows, more = _fetched(result, limit)
    lines = [] if result.frame is None else [" | ".join(result.columns), *(" | ".join(map(str, r)) for r in rows)]
    return "\n".join([*lines, *(["..."] if more else []), result.message])


def run_seed(engine: Engine, text: str) -> int:
    """One statement a line; blank lines and lines that begin with -- are skipped. Errors name their line."""
    done = 0
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.strip().startswith("--"):
            try:
                engine.execute(line)
            except SqlError as e:
                raise SqlError(f"line {n}: {e}") from e
            done += 1
    return done


HELP = "help, stats, exit or quit; sql <statement>, or a statement alone"


def shell(engine: Engine, lines, write) -> None:
    """Reads commands until they end; errors are told, and it goes on."""
    for line in lines:
        line = line.strip()
        if not line:
            continue
        command, _, rest = line.partition(" ")
        if command in ("exit", "quit"):
            return
        if command == "help":
            write(HELP)
        elif command == "stats":
            write(json.dumps(engine.stats()))
        elif command.upper() in ("SQL", "CREATE", "INSERT", "SELECT", "DELETE"):
            try:
                write(to_text(engine.execute(rest if command.lower() == "sql" else line)))
            except SqlError as e:
                write(f"error: {e}")
        else:
            write(f"unknown command: {command}")


class Server:
    """GET /health and GET /query?sql=SELECT...; port 0 takes a free one. stop() is final."""

    def __init__(self, engine: Engine, port: int = 0, host: str = "127.0.0.1"):
        class Handler(BaseHTTPRequestHandler):
            def answer(self, status: int, body: str, kind: str = "application/json") -> None:
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def refuse(self, status: int, message: str) -> None:
                self.answer(status, json.dumps({"error": message}))

            def do_GET(self) -> None:
                url = urlsplit(self.path)
                if url.path == "/health":
                    self.answer(200, "ok", "text/plain")
                elif url.path != "/query":
                    self.refuse(404, "not found")
                elif not (sql := parse_qs(url.query).get("sql", [""])[0]):
                    self.refuse(400, "sql is missing")
                else:
                    try:
                        if not isinstance(parse(sql), Select):
                            raise SqlError("only SELECT is allowed here")
                        self.answer(200, to_json(engine.execute(sql)))
                    except Exception as e:
                        self.refuse(400, str(e))

            def not_allowed(self) -> None:
                self.refuse(405, "only GET is allowed")

            do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = not_allowed

            def log_message(self, *_) -> None:
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def start(self) -> Server:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()
