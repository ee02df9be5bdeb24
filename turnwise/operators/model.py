"""A model's answers to turns: bounded concurrency and a deadline for each call, inside the tasks that hold the turns."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract, folds

BUDGET_MS, CONCURRENCY, RETRIES, MOST_ABANDONED = 1500, 8, 1, 64
#: Takes a turn's key and prompt and returns the model's answer as text.
Client = Callable[[str, str], str]
STATUS = ("ok", "timeout", "error", "skipped")


def http_client(url: str, model: str, system: str = "Label the current turn.", headers: dict[str, str] | None = None, timeout_s: float = 30.0) -> Callable[[], Client]:
    """Makes clients of a chat service that takes JSON messages over HTTP; a turn's key goes along, so a repeated call can be recognised."""

    def make() -> Client:
        def ask(key: str, prompt: str) -> str:
            body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": 0}
            sent = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Idempotency-Key": key} | (headers or {}))
            with urllib.request.urlopen(sent, timeout=timeout_s) as r:
                return json.load(r)["choices"][0]["message"]["content"]

        return ask

    return make


class _Call(threading.Thread):
    """One call with its retries, all with the same key; it ends by itself or is left behind at its deadline."""

    def __init__(self, client: Client, key: str, prompt: str, deadline: float, retries: int):
        super().__init__(daemon=True)
        self.args, self.deadline, self.retries = (client, key, prompt), deadline, retries
        self.began, self.took, self.answer, self.status = time.monotonic(), None, None, "timeout"
        self.start()

    def run(self) -> None:
        client, key, prompt = self.args
        for _ in range(1 + self.retries):
            try:
                answer, status = client(key, prompt), "ok"
            except Exception:  # whatever a client raises, the rules stand
                answer, status = None, "error"
            if status == "ok" or time.monotonic() >= self.deadline:
                break
        self.answer, self.status, self.took = answer, status, time.monotonic() - self.began

    def result(self) -> tuple[str | None, str, int]:
        self.join(max(0.0, self.deadline - time.monotonic()))
        late = self.took is None or self.began + self.took > self.deadline
        ms = int(1000 * (self.took if self.took is not None else time.monotonic() - self.began))
        return (None, "timeout", ms) if late else (self.answer, self.status, ms)


def answers(make: Callable[[], Client], budget_ms: int, concurrency: int, retries: int, rows: Iterator[tuple[str, str]], most_abandoned: int = MOST_ABANDONED) -> Iterator[tuple[str | None, str | None, int]]:
    """(answer, status, ms) of each (key, prompt), in order, at most ``concurrency`` calls at a time.

    A call that is not done ``budget_ms`` after it began has timed out. It may hang on in its thread; where too many
    do, the rest of the task's turns are skipped. Turns without a prompt have no call and no status.
    """
    client, open_calls, left = None, deque(), []

    def finish() -> tuple[str | None, str | None, int]:
        call = open_calls.popleft()
        if call is None or isinstance(call, str):
            return None, call, 0
        found = call.result()
        if call.is_alive():
            left.append(call)
        return found

    for key, prompt in rows:
        if prompt is None:
            open_calls.append(None)
        else:
            while sum(isinstance(c, _Call) for c in open_calls) >= concurrency:
                yield finish()
            left[:] = [c for c in left if c.is_alive()]
            client = client or make()
            open_calls.append("skipped" if len(left) >= most_abandoned else _Call(client, key, prompt, time.monotonic() + budget_ms / 1000, retries))
        if len(open_calls) >= 4 * concurrency:
            yield finish()
    while open_calls:
        yield finish()


def ask(turns: DataFrame, make: Callable[[], Client], budget_ms: int = BUDGET_MS, concurrency: int = CONCURRENCY, retries: int = RETRIES) -> DataFrame:
    """turns (conv_id, turn_idx, speaker, text, ...) with model_answer, model_status and latency_ms of each caller's turn.

    The prompt is the turn after its last four lines. ``make`` builds a client once in a task. Turns of others, and null
    texts, aren't asked about and have nulls. Every turn comes back, whatever the model does.
    """
    t = folds.history_window(turns)
    said = F.concat(F.lit("Context:\n"), F.coalesce("prompt_context", F.lit("")), F.lit("\n\nCurrent turn ["), "speaker", F.lit("]: "), "text")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn_idx").cast("string"))
    t = t.select(*turns.columns, key.alias("__key"), F.when(F.col("speaker") == "caller", said).alias("__prompt"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema], "model_answer string, model_status string, latency_ms long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(answers(make, budget_ms, concurrency, retries, zip(b["__key"], b["__prompt"].where(b["__prompt"].notna(), None))))
            out = b.drop(columns=["__key", "__prompt"])
            yield out.assign(model_answer=[a for a, _, _ in found], model_status=[s for _, s, _ in found], latency_ms=[ms if s else None for _, s, ms in found])

    return t.mapInPandas(run, schema)


def metrics(asked: DataFrame) -> DataFrame:
    """One row: turns asked about, how many ended in each way, and the longest and mean time."""
    n = lambda s: F.count(F.when(F.col("model_status") == s, 1)).alias(s)
    return asked.agg(F.count("model_status").alias("asked"), *[n(s) for s in STATUS], F.max("latency_ms").alias("most_ms"), F.bround(F.avg("latency_ms"), 2).alias("mean_ms"))


def model_extractor(make: Callable[[], Client], **limits) -> extract.Extractor:
    """A stage whose event is the model's, grounded in the text; turns without a usable answer have the rules' event."""

    def stage(turns: DataFrame) -> DataFrame:
        return _merged(extract.rules(ask(turns, make, **limits)), alone=True)

    return stage


def ensemble_extractor(make: Callable[[], Client], **limits) -> extract.Extractor:
    """A stage whose event is the rules' merged with the model's, where that came within the budget."""

    def stage(turns: DataFrame) -> DataFrame:
        return _merged(extract.rules(ask(turns, make, **limits)), alone=False)

    return stage


def _merged(ruled: DataFrame, alone: bool) -> DataFrame:
    answer = extract.parse_answer(F.col("model_answer"))
    j = ruled.withColumn("model_event", F.when(answer.isNotNull(), answer.withField("source", F.lit("llm"))).cast(extract.EVENT))
    j = j.withColumn("__answered", F.col("model_event").isNotNull())
    g = extract.ground(j, "model_event").withColumn("model_event", F.when(F.col("__answered"), F.col("model_event")))
    event = F.coalesce(F.col("model_event"), F.col("event").cast(extract.EVENT)) if alone else extract.merge(F.col("event"), F.col("model_event"))
    return g.withColumn("event", event).drop("model_event", "__answered", "n_kept", "n_dropped", "n_dropped_entities", "downgraded")
