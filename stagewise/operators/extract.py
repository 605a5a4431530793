"""Asking a backend for JSON, one question per row."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.columns import ref
from stagewise.plans.schema import Schema

# A backend factory runs once per task and returns a function from (prompt, schema) to answer text.
Ask = Callable[[str, Schema | None], str]
BackendFactory = Callable[[], Ask]

Answer = tuple[str | None, str | None, int]

ANSWER_TYPE = "answer string, error string, attempts int"

# Fixed value: the schema of a single question.
QUESTION_SCHEMA: Schema = {
    "type": "object",
    "required": ["answer"],
    "properties": {"answer": {"type": "string", "description": "the answer to the prompt"}},
}


def echo_answer(prompt: Column, schema: Schema | None) -> Column:
    """The built-in backend: every field of the schema holds the prompt. Without a schema the answer is empty JSON."""
    fields = sorted((schema or {}).get("properties") or {})
    answer = F.to_json(F.struct(*[prompt.alias(name) for name in fields])) if fields else F.lit("{}")
    return F.struct(
        F.when(prompt.isNotNull(), answer).alias("answer"),
        F.lit(None).cast("string").alias("error"),
        F.when(prompt.isNotNull(), 1).alias("attempts"),
    )


def _ask_with_retries(
    ask: Ask, prompt: str, schema: Schema | None, attempts: int, delay: float
) -> tuple[str | None, str | None, int]:
    error = ""
    for attempt in range(1, attempts + 1):
        try:
            answer = ask(prompt, schema)
            if schema is not None and not isinstance(json.loads(answer), dict):
                raise ValueError("the answer is not a JSON object")
            return answer, None, attempt
        except Exception as failure:  # noqa: BLE001 - the backend is user code; its failure belongs to the row
            error = f"{type(failure).__name__}: {failure}"
            if delay and attempt < attempts:
                time.sleep(delay * 2 ** (attempt - 1))
    return None, error, attempts


class _Asker:
    """The clients of a task, and up to ``in_flight`` questions at a time."""

    def __init__(self, factory: BackendFactory, schema: Schema | None, attempts: int, delay: float, in_flight: int):
        self.factory, self.schema, self.attempts, self.delay = factory, schema, attempts, delay
        self.in_flight = in_flight
        self.local = threading.local()
        self.pool = ThreadPoolExecutor(in_flight) if in_flight > 1 else None

    def client(self) -> Ask:
        """The client of this thread: conversations of one client never overlap."""
        if not hasattr(self.local, "client"):
            self.local.client = self.factory()
        return self.local.client

    def once(self, text: str) -> Answer:
        """A single question, asked one time."""
        ask = self.client()
        if (start := getattr(ask, "start", None)) is not None:
            start()
        return _ask_with_retries(ask, text, self.schema, 1, 0)

    def conversation(self, text: str, openings: Any) -> Answer:
        """A question behind others; each text is repeated by itself, as the conversation goes on."""
        ask = self.client()
        if (start := getattr(ask, "start", None)) is not None:
            start()
        for opening in openings:
            _, error, tried = _ask_with_retries(ask, opening, None, self.attempts, self.delay)
            if error is not None:
                return None, error, tried
        return _ask_with_retries(ask, text, self.schema, self.attempts, self.delay)

    def all(self, ask: Callable[..., Answer], *rows: list) -> list[Answer]:
        """Answers in the order of the rows. Each thread takes the next row by itself, which costs less than handing every row to one."""
        if self.pool is None:
            return list(map(ask, *rows))
        out: list[Any] = [None] * len(rows[0])
        todo, lock = enumerate(zip(*rows, strict=True)), threading.Lock()

        def work() -> None:
            while True:
                with lock:
                    at, row = next(todo, (None, ()))
                if at is None:
                    return
                out[at] = ask(*row)

        for place in [self.pool.submit(work) for _ in range(self.in_flight)]:
            place.result()
        return out

    def batch(self, texts: list[str | None], openings: list[Any]) -> list[tuple]:
        """Answers to the texts of a batch. Single questions that fail are asked again together, in a later pass."""
        out: list[tuple] = [(None, None, None)] * len(texts)
        asked = [i for i, text in enumerate(texts) if text is not None]
        talks = [i for i in asked if openings[i] is not None and len(openings[i])]
        found = self.all(self.conversation, [texts[i] for i in talks], [openings[i] for i in talks])
        for i, answer in zip(talks, found, strict=True):
            out[i] = answer
        todo = [i for i in asked if openings[i] is None or not len(openings[i])]
        for attempt in range(1, self.attempts + 1):
            if attempt > 1 and todo and self.delay:
                time.sleep(self.delay * 2 ** (attempt - 2))
            for i, (answer, error, _) in zip(todo, self.all(self.once, [texts[i] for i in todo]), strict=True):
                out[i] = (answer, error, attempt)
            todo = [i for i in todo if out[i][1] is not None]
        return out

    def close(self) -> None:
        """End the threads."""
        if self.pool:
            self.pool.shutdown(cancel_futures=True)


def backend_answer(
    prompt: Column,
    schema: Schema | None,
    factory: BackendFactory,
    attempts: int,
    delay: float = 0.0,
    before: Column | None = None,
    in_flight: int = 1,
) -> Column:
    """Ask a user backend over Arrow batches. Null prompts are not asked.

    Up to ``in_flight`` questions of a task are open at a time, each by a client of its own; a client is made once per task and place. Answers keep the
    order of the rows. ``before`` holds texts to send first, without schema, in the same conversation; their answers are not kept. A client
    with a ``start`` attribute is told by it that the next row's conversation begins. Failed questions are repeated up to ``attempts``
    times: those of a batch together in passes, with a pause of ``delay`` seconds, doubled each time, between passes; texts of a
    conversation each by itself.
    """
    if in_flight < 1:
        raise ValueError("at least one question has to be in flight")

    def ask_all(batches: Iterator[tuple[list, list]]) -> Iterator[pd.DataFrame]:
        asker = _Asker(factory, schema, attempts, delay, in_flight)
        try:
            for prompts, openings in batches:
                rows = asker.batch(prompts, openings)
                yield pd.DataFrame(rows, columns=["answer", "error", "attempts"]).astype({"attempts": "Int32"})
        finally:
            asker.close()

    def ask_alone(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from ask_all((prompts.tolist(), [None] * len(prompts)) for prompts in batches)

    def ask_behind(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from ask_all((prompts.tolist(), openings.tolist()) for prompts, openings in batches)

    # The hints have to be real types here, as Spark picks the iterator form by them.
    ask_alone.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    ask_behind.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    if before is None:
        return F.pandas_udf(ask_alone, ANSWER_TYPE).asNondeterministic()(prompt)
    # Null lists would make Arrow go over the whole batch again at each row; empty ones do not, and say the same.
    openings = F.coalesce(before, F.array().cast("array<string>"))
    return F.pandas_udf(ask_behind, ANSWER_TYPE).asNondeterministic()(prompt, openings)


def extract(
    df: DataFrame,
    prompt: str,
    schema: Schema | None,
    backend: BackendFactory | None = None,
    attempts: int = 1,
    mode: str = "permissive",
    partitions: int | None = None,
    delay: float = 0.0,
    out: str = "answer",
    in_flight: int = 1,
) -> DataFrame:
    """Add ``answer`` (JSON text, or plain text without a schema), ``_error`` and ``_attempts``.

    ``backend=None`` is the echo. ``partitions`` spreads slow backends over more tasks before they are asked, ``in_flight`` lets each task have several
    questions open. A model must not be asked twice for one row, so write or persist the result before using it in several branches.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    if partitions is not None:
        df = df.repartition(partitions)
    asked = (
        echo_answer(ref(prompt), schema)
        if backend is None
        else backend_answer(ref(prompt), schema, backend, max(1, attempts), delay, None, in_flight)
    )
    answered = df.withColumn("_asked", asked)
    error: Column = F.col("_asked.error")
    if mode == "failfast":
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    return (
        answered.withColumn(out, F.col("_asked.answer"))
        .withColumn("_error", error)
        .withColumn("_attempts", F.col("_asked.attempts"))
        .drop("_asked")
    )


def ask_question(df: DataFrame, prompt: str, backend: BackendFactory | None = None, attempts: int = 1) -> DataFrame:
    """One question per row with a single ``answer`` field, read out of the JSON."""
    asked = extract(df, prompt, QUESTION_SCHEMA, backend, attempts)
    return asked.withColumn("answer", F.get_json_object("answer", "$.answer"))
