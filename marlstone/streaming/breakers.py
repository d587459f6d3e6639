"""Circuit breakers as state machines: closed, open, half-open; the same steps over a table and over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass
class Breaker:
    """State of one key; times in seconds."""

    state: str = CLOSED
    failures: int = 0
    last_failure: int = 0
    probes: int = 0

    def call(self, at: int, failed: bool, least: int, recovery_s: int, most_probes: int) -> bool:
        """Take one call: whether it may run, and what it does to the state. A blocked call changes nothing.

        Some time after the last failure an open breaker lets calls through on probation: a failed one opens it again,
        enough good ones in a row close it.
        """
        if self.state == OPEN and at - self.last_failure >= recovery_s:
            self.state, self.probes = HALF_OPEN, 0
        if self.state == OPEN:
            return False
        if failed:
            self.failures += 1
            self.last_failure = at
            if self.state == HALF_OPEN or self.failures >= least:
                self.state, self.probes = OPEN, 0
        else:
            self.failures = 0
            if self.state == HALF_OPEN:
                self.probes += 1
                if self.probes >= most_probes:
                    self.state, self.probes = CLOSED, 0
        return True


def _seconds(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1_000_000).tolist()


def breaker_states(log: DataFrame, key: str, ts: str, failed: str, order: list[str], least: int = 5, recovery_s: int = 60, probes: int = 3) -> DataFrame:
    """``log`` with ``allowed`` and ``state`` (after the call) of each key's breaker, calls taken in time order.

    One sorted pass: what is kept from one batch to the next is the last key and its state, so a key of any size streams
    through. Rows without a time are left out; a null outcome counts as a failure.
    """
    dealt = log.where(F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts, *order)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = object(), Breaker()
        for b in batches:
            allowed, states = [], []
            for k, t, f in zip(b[key].tolist(), _seconds(b[ts]), b[failed].tolist()):
                k = None if pd.isna(k) else k
                if k != last:
                    last, now = k, Breaker()
                allowed.append(now.call(t, f is None or bool(f), least, recovery_s, probes))
                states.append(now.state)
            yield b.assign(allowed=allowed, state=states)

    return dealt.mapInPandas(scan, _with_state(log))


def _with_state(log: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*log.dtypes, ("allowed", "boolean"), ("state", "string")])


def breaker_stream(log: DataFrame, key: str, ts: str, failed: str, order: list[str], least: int = 5, recovery_s: int = 60, probes: int = 3) -> DataFrame:
    """The same over a stream, whose micro-batches come in time order; the state of a key is kept by Spark from batch to batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(batches)).dropna(subset=[ts]).sort_values([ts, *order])
        got = [(now.call(t, f is None or bool(f), least, recovery_s, probes), now.state) for t, f in zip(_seconds(rows[ts]), rows[failed].tolist())]
        state.update(astuple(now))
        yield rows.assign(allowed=[a for a, _ in got], state=[s for _, s in got])

    return log.groupBy(key).applyInPandasWithState(run, _with_state(log), "state string, failures long, last_failure long, probes long", "append", "NoTimeout")
