"""Requests of bounded size from queues of any length.

A queue is cut greedily: a new request begins where the next text would pass either limit. Where one begins depends on where all before it began, but only
through the request that is open at a boundary. So a queue is cut into runs of ``RUN`` texts. A run's summary tells, for each text
at which its first own request could begin (a request has ``most_texts`` at most, so they are few), what would be open at its end; summaries are
followed from run to run, a row a run, and every run then numbers its texts by what was open before it (``_Run``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.operators import ordinals, scans
from scriptorium.sources import shared

#: Texts of a run.
RUN = 1 << 13


def _first(sums: np.ndarray, n: int, texts: int, tokens: int, most_texts: int, most_tokens: int) -> int:
    """The first of ``n`` texts, with the sums of tokens before each, that doesn't fit into an open request of so many texts and tokens."""
    if not texts or tokens > most_tokens:
        return 0
    return min(int(np.searchsorted(sums, most_tokens - tokens, "right")) - 1, most_texts - texts, n)


class _Run:
    """The token counts of consecutive texts of a queue, and where a request that begins at one of them ends."""

    def __init__(self, tokens: np.ndarray, most_texts: int, most_tokens: int):
        self.sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        self.n, self.most_texts, self.most_tokens = len(tokens), most_texts, most_tokens
        starts = np.arange(self.n)
        by_tokens = np.searchsorted(self.sums, self.sums[:-1] + most_tokens, "right") - 1
        # a text that is longer than a request by itself is one
        self.next = np.minimum(np.maximum(by_tokens, starts + 1), starts + most_texts)

    def first(self, texts: int, tokens: int) -> int:
        """The first text that doesn't fit into the request that is open before the run."""
        return _first(self.sums, self.n, texts, tokens, self.most_texts, self.most_tokens)

    def exits(self) -> np.ndarray:
        """For each text that can be ``first``: requests that begin from it on, and texts and tokens of the last of them."""
        few = min(self.n, self.most_texts + 1)
        requests, last = np.ones(self.n, np.int64), np.arange(self.n)
        for i in range(self.n - 1, -1, -1):
            if self.next[i] < self.n:
                requests[i] += requests[self.next[i]]
                last[i] = last[self.next[i]]
        return np.stack([requests[:few], self.n - last[:few], self.sums[-1] - self.sums[last[:few]]], axis=1)

    def numbers(self, texts: int, tokens: int, before: int) -> np.ndarray:
        """The request of each text, where ``before`` requests have begun."""
        out, at = np.full(self.n, before, np.int64), self.first(texts, tokens)
        while at < self.n:
            before, end = before + 1, int(self.next[at])
            out[at : min(end, self.n)] = before
            at = end
        return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their first two columns, a table for each pair of values."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        if waiting and (waiting[-1].column(0)[-1].as_py(), waiting[-1].column(1)[-1].as_py()) != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def batches(rows: DataFrame, key: str, n_tokens: str, most_texts: int = 512, most_tokens: int = 250_000, hard: int = 300_000, order: str = "ord") -> DataFrame:
    """``<key>, <order>, batch_no`` (from 1 within each ``key``): a new batch where the next text would pass either limit; a text above ``hard`` raises.

    ``order`` tells the texts of a queue apart. A text above ``most_tokens`` is a batch by itself.
    """
    fits = F.assert_true(F.col(n_tokens) <= hard, F.lit("a text is longer than a request may be"))
    kind = dict(rows.dtypes)
    queue = rows.select(F.col(key).alias("queue"), F.col(order).alias("place"), F.col(n_tokens).cast("long").alias("n"), fits.alias("ok")).where("ok is null").drop("ok")
    placed = shared.stored(ordinals.numbered(queue, ["place"], ["queue"]).withColumn("run", scans.run_of("ordinal", RUN)), "queue")
    dealt = placed.select("queue", "run", "ordinal", "place", "n").repartition("queue", "run").sortWithinPartitions("queue", "run", "ordinal")
    queue_type, place_type = to_arrow_type(placed.schema["queue"].dataType), to_arrow_type(placed.schema["place"].dataType)

    def summary(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _grouped(found):
            own = _Run(run.column("n").to_numpy(), most_texts, most_tokens)
            columns = [pa.array([x], t) for x, t in ((run.column(0)[0].as_py(), queue_type), (run.column(1)[0].as_py(), pa.int64()), (own.sums[: most_texts + 2].tobytes(), pa.binary()), (own.exits().tobytes(), pa.binary()), (own.n, pa.int64()), (int(own.sums[-1]), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["queue", "run", "sums", "exits", "size", "all"])

    def followed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, (0, 0, 0)
        for batch in found:
            states = []
            for queue, run, sums, exits, size, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (queue, 1) != of:
                    of, state = (queue, 1), (0, 0, 0)
                states.append((run, *state))
                texts, tokens, before = state
                first = _first(np.frombuffer(sums, np.int64), size, texts, tokens, most_texts, most_tokens)
                if first >= size:
                    state = (texts + size, tokens + whole, before)
                else:
                    began, last_texts, last_tokens = np.frombuffer(exits, np.int64).reshape(-1, 3)[first].tolist()
                    state = (last_texts, last_tokens, before + began)
            columns = [batch.column(0), *(pa.array([s[i] for s in states], pa.int64()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["queue", "run", "texts", "tokens", "before"])

    def numbered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _grouped(found):
            state = [run.column(c)[0].as_py() for c in ("texts", "tokens", "before")]
            numbers = _Run(run.column("n").to_numpy(), most_texts, most_tokens).numbers(*state)
            columns = [run.column("queue").combine_chunks().cast(queue_type), run.column("place").combine_chunks().cast(place_type), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays(columns, [key, order, "batch_no"])

    queue_kind = kind[key]
    runs = dealt.mapInArrow(summary, f"queue {queue_kind}, run long, sums binary, exits binary, size long, all long")
    states = runs.repartition("queue").sortWithinPartitions("queue", "run").mapInArrow(followed, f"queue {queue_kind}, run long, texts long, tokens long, before long")
    states = shared.stored(states, "states").select(F.col("queue").alias("_queue"), F.col("run").alias("_run"), "texts", "tokens", "before")
    met = placed.join(states, placed["queue"].eqNullSafe(states["_queue"]) & (placed["run"] == states["_run"])).select("queue", "run", "ordinal", "place", "n", "texts", "tokens", "before")
    out = met.repartition("queue", "run").sortWithinPartitions("queue", "run", "ordinal").mapInArrow(numbered, f"`{key}` {queue_kind}, `{order}` {kind[order]}, batch_no long")
    return out.withColumn("batch_no", F.col("batch_no").cast("int"))
