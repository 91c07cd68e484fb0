"""Publishing an export: copies to any file system, and a file server with CORS and byte ranges."""

from __future__ import annotations

import json
import os
import re
import socket
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from annospark.sources.links import encode_link
from annospark.sources.shards import put_file, write_files


def upload_json(value, path: str) -> str:
    put_file(path, json.dumps(value).encode())
    return path


def upload_states(states: DataFrame, directory: str, name_col: str = "name", state_col: str = "state") -> int:
    """One JSON file a row, written by the executors."""
    from pyspark.sql import functions as F

    return write_files(states.select(F.concat(F.lit(directory.rstrip("/") + "/"), F.col(name_col), F.lit(".json")).alias("name"), F.col(state_col).cast("binary").alias("value")))


def upload_state(state: dict, path: str, server: str) -> str:
    """Writes a state and returns a link that names it."""
    return f"{server}/#!{upload_json(state, path)}" if path.endswith(".json") else encode_link(server, state)


class CorsHandler(SimpleHTTPRequestHandler):
    """Static files for a viewer on another origin; one byte range a request."""

    def end_headers(self):
        self.send_header("Access-Control-Allow-Origin", "*")
        self.send_header("Access-Control-Allow-Headers", "Range")
        self.send_header("Access-Control-Expose-Headers", "Content-Range, Content-Length, Accept-Ranges")
        self.send_header("Accept-Ranges", "bytes")
        super().end_headers()

    def do_OPTIONS(self):
        self.send_response(204)
        self.end_headers()

    def do_GET(self):
        asked = re.fullmatch(r"bytes=(\d*)-(\d*)", self.headers.get("Range", ""))
        path = self.translate_path(self.path)
        if not asked or not os.path.isfile(path) or asked[0] == "bytes=-":
            return super().do_GET()
        size = os.path.getsize(path)
        first, last = asked[1], asked[2]
        start = int(first) if first else max(0, size - int(last))
        end = min(size - 1, int(last)) if first and last else size - 1
        if start > end:
            self.send_response(416)
            self.send_header("Content-Range", f"bytes */{size}")
            return self.end_headers()
        self.send_response(206)
        self.send_header("Content-Type", self.guess_type(path))
        self.send_header("Content-Range", f"bytes {start}-{end}/{size}")
        self.send_header("Content-Length", str(end - start + 1))
        self.end_headers()
        with open(path, "rb") as f:
            f.seek(start)
            self.wfile.write(f.read(end - start + 1))

    def log_message(self, *args):
        pass


def serve(directory: str, port: int = 9000, bind: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server; call ``serve_forever`` on it, in a thread if need be."""
    return ThreadingHTTPServer((bind, port), partial(CorsHandler, directory=directory))


def local_address() -> str:
    """The address by which this machine reaches others (no packet is sent); the loopback one without a network."""
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.connect(("192.0.2.1", 9))
            return s.getsockname()[0]
    except OSError:
        return "127.0.0.1"
