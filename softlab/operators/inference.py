"""Calling an external model from executors.

No vendor client lives here: the caller passes ``client``, a picklable
function ``list[str] -> list[dict | None]`` (or ``list[list[float]]`` for
embeddings).  Calls run inside ``mapInPandas`` in batches of ``batch``
rows, one output row per input row; a failed call yields a null result and
an error string instead of failing the task, and transient errors are
retried with backoff.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from ..sources.published import publish, published, read_published
from .filters import quarantine


def _call_with_retries(client, items, retries: int, backoff: float):
    last = None
    for attempt in range(retries + 1):
        try:
            out = client(items)
            if len(out) != len(items):
                raise ValueError("client returned a different number of results")
            return out, None
        except Exception as e:  # noqa: BLE001 - reported per row
            last = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(backoff * (2 ** attempt))
    return [None] * len(items), last


def _in_batches(client, items: list, batch: int, retries: int, backoff: float) -> tuple[list, list]:
    """Results and errors of all items, from calls of ``batch`` each; they leave a
    task as one frame, since a frame for every call costs more than a short call."""
    got, errors = [], []
    for start in range(0, len(items), batch):
        res, err = _call_with_retries(client, items[start:start + batch], retries, backoff)
        got += res
        errors += [err if r is None else None for r in res]
    return got, errors


def infer(df: DataFrame, prompt_col: str, client: Callable, batch: int = 32, retries: int = 2,
          backoff: float = 0.5, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keep columns + ``response`` (JSON string or null) + ``error``."""
    cols = list(keep) + [prompt_col]

    def run(it):
        for pdf in it:
            out, (got, errors) = pdf[list(keep)].copy(), _in_batches(client, pdf[prompt_col].tolist(), batch, retries, backoff)
            out["response"] = [None if r is None else json.dumps(r) for r in got]
            out["error"] = errors
            yield out

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + ["response string", "error string"])
    return df.select(*cols).mapInPandas(run, schema)


def embed(df: DataFrame, text_col: str, client: Callable, batch: int = 64, retries: int = 2, backoff: float = 0.5,
          keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keep columns + ``embedding array<float>`` (null on failure) + ``error``."""
    def run(it):
        for pdf in it:
            out, (got, errors) = pdf[list(keep)].copy(), _in_batches(client, pdf[text_col].tolist(), batch, retries, backoff)
            out["embedding"] = [None if r is None else [float(x) for x in r] for r in got]
            out["error"] = errors
            yield out

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + ["embedding array<float>", "error string"])
    return df.select(*keep, text_col).mapInPandas(run, schema)


def parse_responses(df: DataFrame, schema: str, response: str = "response") -> DataFrame:
    """JSON response -> typed struct columns (PERMISSIVE: a bad row is
    null, not a failed batch)."""
    parsed = F.from_json(F.col(response), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_parsed", parsed).select("*", "_parsed.*").drop("_parsed")


def _round(req: DataFrame, client: Callable, response_schema: str, valid: Callable, prompt_col: str, log: str | None,
           name: str) -> DataFrame:
    """The valid rows of one round, written once: to the shared folder, or published
    in ``log`` under ``name``, from where a later run takes them."""
    spark = req.sparkSession
    if log is not None and name in published(spark, log):
        return read_published(spark, log, name)
    parsed = parse_responses(infer(req, prompt_col, client, keep=tuple(
        c for c in req.columns if c != prompt_col)), response_schema)
    ok, _bad = quarantine(parsed, valid(parsed))
    ok = ok.drop("response", "error")
    if log is None:
        return shared_table(ok, "generated-round")
    publish(ok, log, name)
    return read_published(spark, log, name)


def generate_until(make_requests: Callable[[int], DataFrame], n: int, client: Callable,
                   out_path: str, response_schema: str, valid: Callable, max_rounds: int = 100,
                   prompt_col: str = "prompt", log: str | None = None) -> int:
    """Repeat batches until at least ``n`` valid rows were appended (the
    overshoot of the last batch is kept).  Each round is: requests ->
    infer -> parse -> quarantine -> append (S8).  Returns the valid count;
    raises if ``max_rounds`` rounds don't yield ``n``.

    A round's rows are written to the shared folder once; the count and the
    appended lines both come from there, so a lost executor calls nothing
    again and the two can't differ.  With ``log`` (a shared folder) each round is
    published there and its lines replace folder ``round=<i>`` of ``out_path``: a
    driver that starts again goes on where it stopped, repeats no client call of
    a published round and appends no line twice."""
    total = 0
    for i in range(max_rounds):
        if total >= n:
            break
        ok = _round(make_requests(i), client, response_schema, valid, prompt_col, log, f"round-{i:05d}")
        cnt = ok.count()
        if log is not None:
            ok.write.mode("overwrite").json(f"{out_path.rstrip('/')}/round={i}")
        elif cnt:
            ok.write.mode("append").json(out_path)
        total += cnt
    if total < n:
        raise RuntimeError(f"{total} valid rows after {max_rounds} rounds; {n} were asked for")
    return total


def feedback_loop(make_requests: Callable[[int, DataFrame | None], DataFrame], iterations: int,
                  client: Callable, response_schema: str, valid: Callable, interval: int,
                  refresh_pool: Callable[[DataFrame], DataFrame], prompt_col: str = "prompt", log: str | None = None) -> DataFrame:
    """Generate -> append to the training set (U2) -> every ``interval``
    iterations refresh the helpful-example pool (random, or top-k by
    influence) -> few-shot the next batch from the pool.  Each iteration
    writes its own rows to the shared folder; the training set is their union,
    and no row is written twice.  With ``log`` iterations and pools are published
    there, and a driver that starts again goes on after the last of them."""
    from .reshape import append_batch
    train = None
    pool = None
    for i in range(iterations):
        ok = _round(make_requests(i, pool), client, response_schema, valid, prompt_col, log, f"iteration-{i:05d}")
        train = ok if train is None else append_batch(train, ok)
        if interval > 0 and (i + 1) % interval == 0:
            pool = _pool(refresh_pool, train, log, f"pool-{i:05d}")
    return train


def _pool(refresh_pool: Callable, train: DataFrame, log: str | None, name: str) -> DataFrame:
    if log is None:
        return shared_table(refresh_pool(train), "helpful-pool")
    spark = train.sparkSession
    if name not in published(spark, log):
        publish(refresh_pool(train), log, name)
    return read_published(spark, log, name)
