"""Services behind one interface: chat, embeddings, vision, OCR, reranking, web search. The defaults work offline.

A service is a function over batches; :func:`apply` runs it on a column in Arrow batches, with retries. Callers
register their own under a name; an unknown name is an error, a missing service falls back to the offline one.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from urllib.error import HTTPError, URLError

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrain.functions.text import STOP_WORDS

Batch = Callable[[Sequence[str]], list]
REFUSALS = ("i cannot", "i can't", "i'm unable", "i am unable", "no image", "cannot see")


def offline_chat(prompts: Sequence[str]) -> list[str]:
    """The first four context lines of over 40 characters; ``{}`` where JSON is asked for."""
    out = []
    for prompt in prompts:
        if "json" in (prompt or "").lower():
            out.append("{}")
            continue
        lines = [x.strip() for x in (prompt or "").splitlines() if len(x.strip()) > 40]
        out.append("\n".join(lines[:4]))
    return out


def offline_embed(texts: Sequence[str], dim: int = 384) -> list[list[float]]:
    """Hashed words and pairs of words, normalised; the same vectors as the DataFrame form."""
    stop, out = set(STOP_WORDS), []
    for text in texts:
        words = [w for w in (t.lower() for t in re.findall(r"[A-Za-z0-9_]+", text or "")) if len(w) > 1 and w not in stop]
        v = np.zeros(dim)
        for gram in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False))]:
            h = int(hashlib.md5(gram.encode()).hexdigest(), 16)
            v[h % dim] += -1.0 if h >> 8 & 1 else 1.0
        n = np.sqrt((v * v).sum())
        out.append((v / n if n else v).tolist())
    return out


def offline_none(items: Sequence[str]) -> list[str]:
    """Nothing: vision, OCR and search without a service."""
    return ["" for _ in items]


SERVICES: dict[str, dict[str, Batch]] = {
    "chat": {"offline": offline_chat},
    "embed": {"offline": offline_embed},
    "vision": {"offline": offline_none},
    "ocr": {"offline": offline_none},
    "search": {"offline": offline_none},
}


def register(kind: str, name: str, service: Batch) -> None:
    SERVICES[kind][name] = service


def with_retries(call: Batch, tries: int = 4, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Batch:
    """``call``, tried again with doubled waits where the server is busy or out of reach."""

    def attempt(items: Sequence[str]) -> list:
        wait = first_wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(items)
            except (HTTPError, URLError, ConnectionError, TimeoutError) as e:
                busy = not isinstance(e, HTTPError) or e.code == 429 or e.code >= 500
                if not left or not busy:
                    raise
                sleep(wait)
                wait *= 2
        return []

    return attempt


def is_refusal(text: str | None) -> bool:
    """Whether a description is none: too short, or an apology."""
    s = (text or "").strip().lower()
    return len(s) < 25 or any(m in s[:200] for m in REFUSALS)


def apply(kind: str, column: Column, name: str = "offline", returns: str = "string") -> Column:
    """A service on a column, batch by batch."""
    call = with_retries(SERVICES[kind][name])

    @F.pandas_udf(returns)
    def run(items: pd.Series) -> pd.Series:
        return pd.Series(call(items.tolist()), dtype=object)

    return run(column)
