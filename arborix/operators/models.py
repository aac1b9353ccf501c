"""Asking a model service about rows: batches, retries, answers in the order of the questions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a client inside a task: a function from questions to as many answers, in their order.
Factory = Callable[[], Callable[[list[str]], list]]


@dataclass(frozen=True)
class Retry:
    """Attempts at a batch, and the wait between them: doubled from ``first`` up to ``most`` seconds, with some jitter.

    Errors of the caller (``never``) are not tried again.
    """

    attempts: int = 3
    first: float = 1.0
    most: float = 8.0
    jitter: float = 0.25
    never: tuple[type[Exception], ...] = (TypeError, AttributeError, NameError, LookupError, NotImplementedError)

    def call(self, ask: Callable[[list[str]], list], questions: list[str]) -> list:
        for attempt in range(1, self.attempts + 1):
            try:
                answers = list(ask(questions))
                if len(answers) != len(questions):
                    raise ValueError(f"{len(answers)} answers to {len(questions)} questions")
                return answers
            except Exception as error:
                if attempt == self.attempts or isinstance(error, self.never):
                    raise
                time.sleep(min(self.most, self.first * 2 ** (attempt - 1)) + random.uniform(0, self.jitter))
        raise ValueError("a batch needs at least one attempt")


def _asked(text: Column, factory: Factory, kind: str, size: int, retry: Retry, check: Callable[[list], None]) -> Column:
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            at = [i for i, t in enumerate(part) if isinstance(t, str)]
            for k in range(0, len(at), size):
                run = at[k : k + size]
                answers = retry.call(client, [part.iloc[i] for i in run])
                check(answers)
                for i, answer in zip(run, answers, strict=True):
                    out.iat[i] = answer
            yield out

    return F.pandas_udf(ask, kind).asNondeterministic()(text)


def answered(text: Column, factory: Factory, *, size: int = 16, retry: Retry = Retry()) -> Column:
    """The answers of a model; a null question has a null answer. A batch that fails to the last attempt fails its task."""
    return _asked(text, factory, "string", size, retry, lambda answers: None)


def tried(question: Callable[[Column, Column], Column], factory: Factory, *, size: int = 16, retry: Retry = Retry()) -> Callable[[Column, Column], Column]:
    """A reply for :func:`figures`: asks a model ``question(question, text)`` and gives a struct (answer, error).

    A batch that fails to the last attempt is asked one by one, so only questions that fail by themselves have an error.
    """

    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = factory()

        def told(run: list[str]) -> list[tuple]:
            try:
                return [(a, None) for a in retry.call(client, run)]
            except Exception as error:
                return [(None, f"{type(error).__name__}: {error}")] if len(run) == 1 else [x for one in run for x in told([one])]

        for part in parts:
            rows: list[tuple] = [(None, None)] * len(part)
            at = [i for i, t in enumerate(part) if isinstance(t, str)]
            for k in range(0, len(at), size):
                for i, answer in zip(at[k : k + size], told([part.iloc[i] for i in at[k : k + size]]), strict=True):
                    rows[i] = answer
            yield pd.DataFrame(rows, columns=["answer", "error"])

    asked = F.pandas_udf(ask, "answer string, error string").asNondeterministic()
    return lambda q, text: asked(question(q, text))


def metered(text: Column, factory: Factory, *, size: int = 16, retry: Retry = Retry()) -> Column:
    """The answers of a model that tells what they took: a struct of answer, prompt_tokens and completion_tokens.

    The client gives (answer, prompt tokens, completion tokens). Sums over the rows of a run are its account, so runs
    that go on at the same time do not mix.
    """

    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = factory()
        for part in parts:
            rows: list[tuple] = [(None, 0, 0)] * len(part)
            at = [i for i, t in enumerate(part) if isinstance(t, str)]
            for k in range(0, len(at), size):
                run = at[k : k + size]
                for i, answer in zip(run, retry.call(client, [part.iloc[i] for i in run]), strict=True):
                    rows[i] = tuple(answer)
            yield pd.DataFrame(rows, columns=["answer", "prompt_tokens", "completion_tokens"])

    return F.pandas_udf(ask, "answer string, prompt_tokens long, completion_tokens long").asNondeterministic()(text)


def embedded(text: Column, factory: Factory, *, dimension: int, size: int = 16, retry: Retry = Retry()) -> Column:
    """The embeddings of texts; a vector without ``dimension`` numbers is an error."""

    def check(answers: list) -> None:
        if any(len(a) != dimension for a in answers):
            raise ValueError(f"an embedding has not {dimension} numbers")

    return _asked(text, factory, "array<float>", size, retry, check)
