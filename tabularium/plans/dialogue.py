"""Asking what columns mean: a short dialogue with a completion client, whose answers annotate the profile."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.rows import upsert_annotations
from . import runs
from .search import LLMClient, RetryingLLM, StubLLM

#: Most questions of a session, and messages that are sent along.
QUESTIONS, LAST = 10, 20
SYSTEM = "You document data sets. Ask about columns that are unclear, one question at a time. When nothing is unclear, answer with JSON: {\"Mode\": \"final\", \"columns\": [{\"name\": ..., \"note\": ..., \"confidence\": 0 to 1}]}."
SKIPPED, FINISH = "I don't know, go on.", "Give the final JSON now, with low confidence where you lack information."


@dataclass
class HttpLLM:
    """A client of a chat server over HTTP: ``openai`` (messages in, choices out) or ``ollama`` (messages in, a message out).

    Place and key come from the arguments or the environment; waits and retries are those of ``RetryingLLM``.
    """

    url: str = field(default_factory=lambda: os.environ.get("TABULARIUM_LLM_URL", "http://localhost:11434/api/chat"))
    model: str = field(default_factory=lambda: os.environ.get("TABULARIUM_LLM_MODEL", ""))
    key: str = field(default_factory=lambda: os.environ.get("TABULARIUM_LLM_KEY", ""), repr=False)
    provider: str = "ollama"
    timeout: float = 60.0

    def chat(self, messages: list[dict]) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": m["role"], "content": m["content"]} for m in messages], "stream": False}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)
        except OSError as e:  # refused, timed out, or an HTTP error: those of the server may pass
            if getattr(e, "code", 500) < 500 and getattr(e, "code", 500) != 429:
                raise ValueError(f"the server refused the request: {e}") from e
            raise ConnectionError(str(e)) from e
        return (found["choices"][0]["message"] if self.provider == "openai" else found["message"])["content"]

    def complete(self, prompt: str) -> str:
        return self.chat([{"role": "user", "content": prompt}])

    def repeat(self, prompt: str, n: int) -> list[str]:
        return [self.complete(prompt) for _ in range(n)]


def make_client(provider: str = "stub") -> LLMClient:
    """The client of a provider's name: stub (offline), ollama or openai; the latter two try again when they fail."""
    if provider == "stub":
        return StubLLM()
    if provider not in ("ollama", "openai"):
        raise ValueError(f"no provider {provider}; there are stub, ollama, openai")
    return RetryingLLM(HttpLLM(provider=provider))


def completion_server(client: LLMClient, port: int = 0) -> ThreadingHTTPServer:
    """Completions over HTTP on this machine: POST {"prompt", "repeat_prompt"} gives {"content": [...]}. Start it with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                status, said = 200, {"content": [client.complete(asked["prompt"]) for _ in range(int(asked.get("repeat_prompt", 1)))]}
            except (ValueError, KeyError, TypeError) as e:
                status, said = 400, {"error": str(e)}
            except Exception as e:
                status, said = 502, {"error": f"{type(e).__name__}: {e}"}
            body = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def _salvaged(answer: str):
    for part in (answer, *re.findall(r"(?s)\{.*\}", answer)):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def is_final(answer: str) -> bool:
    found = _salvaged(answer)
    mode = str(found.get("Mode", found.get("mode", ""))).lower() if isinstance(found, dict) else ""
    return mode == "final" or bool(re.search(X.FINAL, answer.lower()))


def command(line: str) -> str | None:
    return X.COMMANDS.get(line.strip().lower())


@dataclass
class Clarified:
    notes: list[dict]
    messages: list[dict]
    error: str | None = None


def clarify(payload: dict, client: LLMClient, answer: Callable[[str], str] | None = None, most: int = QUESTIONS) -> Clarified:
    """Notes on columns from at most ``most`` questions; without ``answer`` (not interactive) the final notes are asked for at once.

    ``skip`` and ``done`` (in several words) pass over a question and end the session. If the client fails, there are no notes.
    """
    messages = [{"role": "system", "content": SYSTEM, "timestamp": time.time()}, {"role": "user", "content": json.dumps(payload, default=str), "timestamp": time.time()}]

    def ask() -> str:
        kept = [m for i, m in enumerate(messages) if i == 0 or i >= len(messages) - LAST]
        said = client.complete("\n".join(f"{m['role']}: {m['content']}" for m in kept))
        messages.append({"role": "assistant", "content": re.sub(r"\s+", " ", said).strip(), "timestamp": time.time()})
        return said

    def tell(line: str) -> None:
        messages.append({"role": "user", "content": line, "timestamp": time.time()})

    try:
        if answer is None:
            tell(FINISH)
        said = ask()
        for _ in range(most):
            if is_final(said) or answer is None:
                break
            line = answer(said)
            meant = command(line)
            tell(FINISH if meant == "done" else SKIPPED if meant == "skip" else line)
            said = ask()
            if meant == "done":
                break
        if not is_final(said):
            tell(FINISH)
            said = ask()
    except Exception as e:  # a client may fail in any way; the profile stands without it
        return Clarified([], messages, f"{type(e).__name__}: {str(e)[:300]}")
    found = _salvaged(said)
    notes = [n for n in (found or {}).get("columns", []) if isinstance(n, dict) and n.get("name")] if isinstance(found, dict) else []
    return Clarified(notes, messages, None if notes else "no notes in the answer")


def conversation_table(spark: SparkSession, messages: list[dict], conv: int = 0) -> DataFrame:
    """(conv_id, turn, role, text, timestamp) of a session."""
    return spark.createDataFrame([(conv, i, m["role"], m["content"], float(m["timestamp"])) for i, m in enumerate(messages)], "conv_id long, turn long, role string, text string, timestamp double")


def analyse(df: DataFrame, target: str, client: LLMClient | None = None, answer: Callable[[str], str] | None = None, **options) -> dict:
    """Profile, compact payload and, with a client, the columns' notes (of enough confidence) and the session."""
    found = runs.profile_dataset(df, [target], **options).to_dict()
    out = {"report": found, "payload": runs.compact(found), "notes": None, "messages": [], "error": None}
    if client is not None:
        said = clarify(out["payload"], client, answer)
        out |= {"messages": said.messages, "error": said.error}
        if said.notes:
            spark = df.sparkSession
            known = spark.createDataFrame([(c["feature"], None) for c in found["columns"]], "name string, note string")
            given = spark.createDataFrame([(str(n["name"]), str(n.get("note", "")), float(n["confidence"]) if n.get("confidence") is not None else None) for n in said.notes], "name string, note string, confidence double")
            out["notes"] = {r["name"]: r["note"] for r in upsert_annotations(known, given).where(F.col("note").isNotNull()).collect()}  # a row a column
    return out
