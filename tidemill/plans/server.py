"""A small server for the query that fetches pages."""

from __future__ import annotations

import contextlib
import http.server
import json
import threading
import urllib.parse
from collections import Counter
from collections.abc import Iterator, Mapping


@contextlib.contextmanager
def rows_served(rows: Mapping[int, tuple[str, float]]) -> Iterator[tuple[str, Counter]]:
    """Address of a server of rows {key: (name, balance)}, and how often it served each key.

    Keys that ten divides fail at first with status 500; those of negative balance are not found.
    """
    served: Counter = Counter()
    guard = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            key = int(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["key"][0])
            name, balance = rows[key]
            with guard:
                served[key] += 1
                first = served[key] == 1
            self.send_response(404 if balance < 0 else 500 if key % 10 == 0 and first else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"s_suppkey": key, "s_name": name}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", served
    finally:
        server.shutdown()
        server.server_close()
