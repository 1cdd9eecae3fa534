"""Drift detectors over route events: one state machine for each stream, in batch or as Structured Streaming."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CERTIFICATE = re.compile("[0-9a-f]{64}")
EVENTS = "stream long, request_id long, kind string, detector string, defers long, n long"


@dataclass(frozen=True)
class Limits:
    """Deferral: share of the last `window` requests at least tau_num/tau_den once `least` were seen. Audit: `fail` disagreements of the last `audits`."""

    window: int = 20
    tau_num: int = 9
    tau_den: int = 10
    audits: int = 50
    fail: int = 10
    least: int = 20


class Machine:
    """CERTIFIED until a detector trips; afterwards requests are ignored until a recertification by a certificate that was never rolled back."""

    def __init__(self, limits: Limits, state: tuple | None = None) -> None:
        self.limits = limits
        open_, seen, defers, audits, cert, revoked = state or (True, 0, (), (), None, ())
        self.open, self.seen, self.cert, self.revoked = open_, seen, cert, list(revoked)
        self.defers, self.audits = deque(defers, limits.window), deque(audits, limits.audits)

    def state(self) -> tuple:
        return self.open, self.seen, list(self.defers), list(self.audits), self.cert, self.revoked

    def recertify(self, cert: str) -> bool:
        """Whether the machine is certified anew: only a tripped one, by 64 hex digits other than those of any certificate rolled back from."""
        if self.open or not CERTIFICATE.fullmatch(cert) or cert in self.revoked:
            return False
        self.open, self.cert, self.seen = True, cert, 0
        self.defers.clear()
        self.audits.clear()
        return True

    def observe(self, deferred: bool, audit: bool | None) -> tuple[str, int, int] | None:
        """audit: whether an audited answer disagreed, None without an audit. (detectors, defers, n) if one trips."""
        if not self.open:
            return None
        x = self.limits
        self.seen += 1
        self.defers.append(bool(deferred))
        if audit is not None:
            self.audits.append(bool(audit))
        n, d = len(self.defers), sum(self.defers)
        fired = ["deferral"] * (self.seen >= x.least and d * x.tau_den >= n * x.tau_num) + ["audit"] * (sum(self.audits) >= x.fail)
        if not fired:
            return None
        self.open = False
        if self.cert and self.cert not in self.revoked:
            self.revoked.append(self.cert)
        self.defers.clear()
        self.audits.clear()
        return "+".join(fired), d, n


def _rows(stream: int, request: int, tripped: tuple[str, int, int]) -> list[tuple]:
    return [(stream, request, kind, *tripped) for kind in ("rollback", "teacher_only", "redistill")]


def _taken(machine: Machine, stream: int, request: int, deferred: bool, audit: bool | None, cert: str | None) -> list[tuple]:
    """What one row makes a machine emit: a row with a certificate is a recertification, any other a request."""
    if isinstance(cert, str):
        return [(stream, request, "recertify", None, 0, 0)] if machine.recertify(cert) else []
    tripped = machine.observe(deferred, audit)
    return _rows(stream, request, tripped) if tripped else []


def _requests(events: DataFrame) -> DataFrame:
    cert = F.col("cert") if "cert" in events.columns else F.lit(None)
    return events.select("stream", "request_id", "deferred", "audit", cert.cast("string").alias("cert"))


def replay(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """events(stream, request_id, deferred, audit[, cert]): what each stream's machine emits, in order of request_id.

    Rows are dealt and sorted by stream in the shuffle and read in passing, so a long stream needs no memory of its length; one
    stream is one task, as each request depends on those before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, machine = None, None
        for batch in batches:
            out = []
            for s, r, d, a, cert in batch.itertuples(index=False):
                if s != stream:
                    stream, machine = s, Machine(limits)
                out += _taken(machine, s, r, d, None if pd.isna(a) else bool(a), cert)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    ordered = _requests(events).repartition("stream").sortWithinPartitions("stream", "request_id")
    return ordered.mapInPandas(run, EVENTS)


def restore(log: DataFrame) -> DataFrame:
    """(stream, state, cert, revoked, detector) after a log of events (stream, seq, kind, state_to, detector, cert): the fold of each stream as one aggregation.

    A log that ends between a rollback and what follows it is settled: its stream is with the teacher. Windows start empty.
    """
    rolled, again = F.col("kind") == "rollback", F.col("kind") == "recertify"
    folded = log.groupBy("stream").agg(
        F.max_by("state_to", "seq").alias("last"), F.max_by(F.when(again, F.col("cert")), F.when(again, F.col("seq"))).alias("cert"),
        F.array_sort(F.collect_set(F.when(rolled, F.col("cert")))).alias("revoked"), F.max_by(F.when(rolled, F.col("detector")), F.when(rolled, F.col("seq"))).alias("tripped"),
    )
    state = F.when(F.col("last") == "rollback", "teacher").otherwise(F.col("last"))
    return folded.select("stream", state.alias("state"), "cert", "revoked", F.when(state != "certified", F.col("tripped")).alias("detector"))


def watch(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The streaming twin: state is a machine for each stream; events of a micro-batch are taken in order of request_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(limits, state.get if state.exists else None)
        out = []
        rows = sorted(((r.request_id, r.deferred, r.audit, r.cert) for b in batches for r in b.itertuples()), key=lambda r: r[0])
        for request, deferred, audit, cert in rows:
            out += _taken(machine, key[0], request, deferred, None if pd.isna(audit) else bool(audit), cert)
        state.update(machine.state())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    kept = "open boolean, seen long, defers array<boolean>, audits array<boolean>, cert string, revoked array<string>"
    return _requests(events).groupBy("stream").applyInPandasWithState(step, EVENTS, kept, "append", GroupStateTimeout.NoTimeout)
