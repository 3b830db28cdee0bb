"""Asking a teacher model: requests from tasks through a transport that the caller gives."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_THOUGHT = re.compile(r"(?s)<think>.*?</think>")


def asked(transport: Callable[[str], str], prompt: str, tries: int = 8, wait: Callable[[float], None] = time.sleep) -> str:
    """A reply without its thoughts; failures are tried again after 10, 20, 40 … up to 300 seconds.

    ``PermissionError`` ends it at once.
    """
    for i in range(tries):
        try:
            return _THOUGHT.sub("", transport(prompt)).strip()
        except PermissionError:
            raise
        except Exception:
            if i == tries - 1:
                raise
            wait(min(300.0, 10.0 * 2**i))
    raise RuntimeError("no tries")


def replies(requests: DataFrame, transport: Callable[[str], str], deadline: float | None = None, tries: int = 8) -> DataFrame:
    """``record_id, reply`` for ``record_id, prompt``; after ``deadline`` (seconds since the epoch) replies are null."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            late = lambda: deadline is not None and time.time() > deadline
            yield pd.DataFrame({"record_id": batch["record_id"], "reply": [None if late() else asked(transport, p, tries) for p in batch["prompt"]]})

    return requests.select("record_id", "prompt").mapInPandas(ask, "record_id string, reply string")
