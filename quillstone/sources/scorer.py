"""External scorers: configuration, and calls from executors with retries. The default scorer replays recorded responses."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ScorerConfig:
    model: str = "replay"
    base_url: str = ""
    timeout: float = 300.0
    connect_timeout: float = 60.0
    retries: int = 2
    temperature: float = 0.2

    @staticmethod
    def resolve(secrets_path: str | None = None, prefix: str = "SCORER_", env: dict[str, str] | None = None) -> ScorerConfig:
        """Each value from the environment, else the secrets file, else the default. Keys stay in the process; they never enter a plan."""
        env = dict(os.environ) if env is None else env
        secrets = json.load(open(secrets_path, encoding="utf-8")) if secrets_path and os.path.exists(secrets_path) else {}
        out = {}
        for name, field in ScorerConfig.__dataclass_fields__.items():
            raw = env.get(prefix + name.upper(), secrets.get(name, field.default))
            out[name] = type(field.default)(raw)
        return ScorerConfig(**out)


def call_scorer(prompts: DataFrame, scorer: Callable[[str, int], str], seed: int = 0, attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """(input_id, mode, prompt_sha256, response, attempt, error) of ``scorer(prompt, seed + attempt)`` for every prompt.

    A failed call is tried again with growing pauses; after the last attempt the row carries the error instead of failing the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                response, error, attempt = None, None, 0
                for attempt in range(attempts):
                    try:
                        response, error = scorer(r.prompt, seed + attempt), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the scorer raises is reported per row
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < attempts:
                            time.sleep(backoff * (attempt + 1))
                rows.append((r.input_id, r.mode, r.prompt_sha256, response, attempt, error))
            yield pd.DataFrame(rows, columns=["input_id", "mode", "prompt_sha256", "response", "attempt", "error"])

    kind = prompts.schema["input_id"].dataType.simpleString()
    return prompts.select("input_id", "mode", "prompt", "prompt_sha256").mapInPandas(run, f"input_id {kind}, mode string, prompt_sha256 string, response string, attempt int, error string")
