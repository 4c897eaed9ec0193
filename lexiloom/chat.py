"""A chat page over an index: the standard library's server, one Spark query for each question.

The page keeps the conversation; the server keeps nothing but the index.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from .plans.config import Settings
from .plans.ingest import ask

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:16px sans-serif;max-width:50em;margin:2em auto}}.user{{font-weight:bold}}summary{{color:#555}}</style>
<h1>{title}</h1><div id="said"></div><form><input name="q" size="60" autofocus><button>Ask</button></form>
<script>
const said = document.getElementById("said"), form = document.forms[0];
const add = (kind, text) => {{ const p = document.createElement("p"); p.className = kind; p.textContent = text; said.append(p); return p; }};
form.onsubmit = async e => {{
  e.preventDefault();
  const question = form.q.value.trim();
  if (!question) return;
  form.q.value = "";
  add("user", question);
  const p = add("answer", "\\u2026");
  const got = await (await fetch("ask", {{method: "POST", body: JSON.stringify({{question}})}})).json();
  p.textContent = got.answer ?? got.error;
  if (got.sources?.length) {{
    const d = document.createElement("details");
    d.innerHTML = "<summary>Sources</summary>";
    for (const s of got.sources) {{ const line = document.createElement("div"); line.textContent = `${{s.section_title}} (${{s.content_type}}) ${{s.url}}`; d.append(line); }}
    p.append(d);
  }}
}};
</script>"""

Answer = Callable[[str], dict]


def answerer(records: DataFrame, settings: Settings = Settings(), **options) -> Answer:
    """A question to {answer, sources} by the whole plan over ``records``."""

    def answer(question: str) -> dict:
        asked = records.sparkSession.createDataFrame([(0, question)], "query_id long, question string")
        row = ask(records, asked, settings, **options).select("answer", "sources").first()
        return {"answer": row.answer, "sources": [s.asDict() for s in row.sources]}

    return answer


def server(answer: Answer, port: int = 8501, title: str = "Ask the collection") -> ThreadingHTTPServer:
    """A server for the page and for questions posted to ``/ask`` as {"question": ...}; a failing plan is an error of that question alone."""
    page = _PAGE.format(title=html.escape(title)).encode()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(200, "text/html; charset=utf-8", page) if self.path == "/" else self._send(404, "text/plain", b"no such page")

        def do_POST(self) -> None:
            try:
                question = str(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["question"]).strip()
            except (ValueError, KeyError, TypeError):
                return self._send(400, "application/json", b'{"error": "no question"}')
            try:
                status, said = 200, answer(question) if question else {"answer": "", "sources": []}
            except Exception as e:
                status, said = 500, {"error": str(e).partition("\n")[0]}
            self._send(status, "application/json", json.dumps(said).encode())

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
