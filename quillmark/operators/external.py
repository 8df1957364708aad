"""External calls (models, HTTP services) as a table function with a memo table (EX1-EX8, D23).

Requests are answered from the memo; only what is not there goes to the provider, in parallel and in batches; answers are
appended, failures as rows with an error, which a later run asks again. A provider is a function from a list of payloads to
a list of (response, error); tests and offline runs use ``replay`` or a deterministic stub, so results are reproducible.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.skew import skew_join
from quillmark.session import materialize

Provider = Callable[[list[str]], list[tuple[str | None, str | None]]]
MEMO = "key string, operation string, response string, error string"


def memo_key(operation: str, version: str, model: str, payload: Column) -> Column:
    """A key over operation, prompt version, model and the whole payload."""
    return F.sha2(F.concat_ws("|", F.lit(operation), F.lit(version), F.lit(model), F.coalesce(payload, F.lit(""))), 256)


def call(requests: DataFrame, memo: DataFrame, provider: Provider, operation: str, batch: int = 32, tasks: int = 8, tries: int = 3, wait: float = 0.0, pause: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(answers, new memo rows) of requests (key, payload).

    Repeated keys are asked once. An error counts as no answer: after `tries` attempts it comes out as a row with the error
    and a NULL response, and the job goes on (PL14). A batch that fails as a whole is asked again payload by payload, so one
    bad payload spoils no other. All tasks together send a batch every `wait` seconds at most; before an attempt is
    repeated, at least `pause` seconds pass, twice as many each time, up to 16 (EX6).
    """
    good = memo.filter((F.col("operation") == operation) & F.col("error").isNull()).select("key", "response")
    todo = skew_join(requests.groupBy("key").agg(F.first("payload").alias("payload")), good.select("key").distinct(), ["key"], "left_anti", "key")

    def asked(payloads: list[str]) -> list[tuple[str | None, str | None]]:
        error = ""
        for attempt in range(tries):
            try:
                return provider(payloads)
            except Exception as e:  # noqa: BLE001 - a failure is a row, not the job's end
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 < tries:
                    time.sleep(min(16.0, max(wait, pause) * 2**attempt))
        return [(None, error)] if len(payloads) == 1 else [x for p in payloads for x in asked([p])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a:a + batch]
                answers = asked(list(part["payload"]))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "operation": operation, "response": [x for x, _ in answers], "error": [x for _, x in answers]})
                if wait:
                    time.sleep(wait * tasks)

    new = materialize(todo.repartition(tasks).mapInPandas(run, MEMO), "memo")
    known = good.unionByName(new.filter("error is null").select("key", "response")).groupBy("key").agg(F.first("response").alias("response"))
    failed = new.filter("error is not null").select("key", "error")
    return requests.join(known, "key", "left").join(failed, "key", "left"), new


def replay(answers: dict[str, str]) -> Provider:
    """A provider that knows its answers by payload."""
    return lambda payloads: [(answers.get(p), None if p in answers else "not recorded") for p in payloads]


def stub(payloads: list[str]) -> list[tuple[str | None, str | None]]:
    """A deterministic provider: a digest of the payload."""
    return [(json.dumps({"digest": hashlib.sha256((p or "").encode()).hexdigest()[:12]}), None) for p in payloads]
