"""Folds whose next step needs the last one's result: one pass over sorted rows, with one state for each key.

Rows are dealt by key, sorted within partitions and streamed in Arrow batches, so memory holds a batch and a
state, however many rows a key has. Keys run in parallel; a key runs in order, as its meaning demands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[dict], object], step: Callable[[object, dict], tuple[object, list[tuple]]], finish: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """``start`` makes a state from a key's first row, ``step`` gives the next state and output rows, ``finish`` the last rows."""
    target = _parse_datatype_string(schema)
    assert isinstance(target, StructType)
    arrow = to_arrow_schema(target)
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if current is None or key != current[0]:
                    if current is not None:
                        out += finish(state)
                    current, state = (key,), start(row)
                state, more = step(state, row)
                out += more
            yield _rows(out, arrow)
        if current is not None:
            yield _rows(finish(state), arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def token_bucket(requests: DataFrame, rate_per_s: float, burst: float, principal: str = "by", stamp: str = "t_ns", order: Sequence[str] = ("seq",)) -> DataFrame:
    """key, seq, admitted, tokens for every request: a full bucket at first, refilled by stamps, one token for each admission.

    A token is spent when the request is let in, whatever becomes of it later.
    """

    def start(row):
        return [burst, row[stamp]]

    def step(state, row):
        tokens = min(burst, state[0] + max(0, row[stamp] - state[1]) / 1e9 * rate_per_s)
        ok = tokens >= 1
        tokens -= ok
        return [tokens, row[stamp]], [(row[principal], row[order[-1]], ok, tokens)]

    kind = dict(requests.dtypes)
    return ordered_fold(requests, [principal], [stamp, *order], start, step, lambda s: [], f"{principal} {kind[principal]}, {order[-1]} long, admitted boolean, tokens double")


def coalesced_refusals(refusals: DataFrame, window_ns: int, keys: Sequence[str] = ("by", "reason", "constraint_id", "cell"), stamp: str = "now_ns", seq: str = "seq") -> DataFrame:
    """Entries of refusals by key: the opener alone, then what came within ``window_ns`` of it, told when the window ends.

    The window is anchored at its first refusal: neither aligned to a clock nor prolonged by later ones. Counts
    add up to the number of refusals. first_seq and last_seq tell which a row stands for.
    """
    keys = list(keys)

    def start(row):
        return None

    def entry(state):
        return [(*state["key"], state["pending"], state["first"], state["last"], "pending")] if state and state["pending"] else []

    def step(state, row):
        key = tuple(row[k] for k in keys)
        if state is not None and row[stamp] - state["opened"] <= window_ns:
            first = state["first"] if state["pending"] else row[seq]
            return state | {"pending": state["pending"] + 1, "first": first, "last": row[seq]}, []
        out = [*entry(state), (*key, 1, row[seq], row[seq], "opener")]
        return {"key": key, "opened": row[stamp], "pending": 0, "first": None, "last": None}, out

    kinds = dict(refusals.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, first_seq long, last_seq long, role string"
    return ordered_fold(refusals, keys, [stamp, seq], start, step, entry, schema)
