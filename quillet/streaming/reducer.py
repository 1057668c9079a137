"""Progress events as a stream: each attempt's regions are reduced in sequence order, whatever order events come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "attempt_id long, region_id long, state string, seq long, error string"
_STATE = "body string"
TERMINAL = ("completed", "failed")


class Attempt:
    """The state of one attempt: the next sequence number, what waits for a gap to close, and the regions."""

    def __init__(self, body: str | None = None, strict: bool = False):
        kept = json.loads(body) if body else {}
        self.next = kept.get("next", 1)
        self.waiting: dict[int, list] = {int(k): v for k, v in kept.get("waiting", {}).items()}
        self.regions: dict[int, list] = {int(k): v for k, v in kept.get("regions", {}).items()}
        self.retired: set[int] = set(kept.get("retired", []))
        self.ended = kept.get("ended", False)
        self.error = kept.get("error")
        self.strict = strict

    def dump(self) -> str:
        return json.dumps({"next": self.next, "waiting": self.waiting, "regions": self.regions, "retired": sorted(self.retired), "ended": self.ended, "error": self.error})

    def offer(self, seq: int, kind: str, region: int | None, parents: list[int] | None = None) -> None:
        """Take an event; those ahead of a gap wait, those seen before are passed over."""
        if seq >= self.next:
            self.waiting.setdefault(seq, [kind, region, parents or []])
        while self.next in self.waiting:
            self.apply(self.next, *self.waiting.pop(self.next))
            self.next += 1

    def apply(self, seq: int, kind: str, region: int | None, parents: list[int]) -> None:
        if self.error:
            return
        if self.ended:
            if self.strict:
                self.error = f"event {seq} after the end"
            return
        if kind in TERMINAL:
            self.ended = True
            if kind == "failed":
                self.regions = {}
        elif region in self.retired:
            self.error = f"region {region} was removed and can't return" if self.strict else None
        elif kind == "removed":
            self.regions.pop(region, None)
            self.retired.add(region)
        elif kind == "replaced":
            if region in self.regions or region in parents:
                self.error = f"region {region} is not new" if self.strict else None
                return
            for parent in parents:
                self.regions.pop(parent, None)
                self.retired.add(parent)
            self.regions[region] = ["found", seq]
        elif region is not None:
            self.regions[region] = [kind, seq]


def reduce_progress(events: DataFrame, strict: bool = False, forget: bool = False) -> DataFrame:
    """Per micro-batch and attempt touched: its regions' states after all events without a gap before them.

    events: (attempt_id, seq, kind, region_id) and optionally parents, a stream. strict: an event after the
    end, or for a region that was removed, is an error, in a row of its own where the attempt has no
    regions; tolerant: it is passed over. State grows with an attempt's live regions and the events that
    wait for a gap; after the end a few bytes say that it ended, or nothing with forget, where a source
    never repeats an attempt's events.
    """
    with_parents = "parents" in events.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt = Attempt(state.get[0] if state.exists else None, strict)
        for batch in batches:
            parents = batch.parents if with_parents else [None] * len(batch)
            for seq, kind, region, own in zip(batch.seq, batch.kind, batch.region_id, parents):
                attempt.offer(int(seq), kind, None if pd.isna(region) else int(region), None if own is None else [int(p) for p in own])
        rows = [(key[0], r, s, q, attempt.error) for r, (s, q) in sorted(attempt.regions.items())]
        if attempt.error and not rows:
            rows = [(key[0], None, None, None, attempt.error)]
        if attempt.ended:
            attempt.waiting, attempt.retired = {}, set()
            if not strict:
                attempt.regions = {}
        if attempt.ended and forget:
            state.remove()
        else:
            state.update((attempt.dump(),))
        yield pd.DataFrame(rows, columns=["attempt_id", "region_id", "state", "seq", "error"]).astype({"region_id": "Int64", "seq": "Int64"})

    return events.groupBy("attempt_id").applyInPandasWithState(step, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def reduce_all(rows: list[tuple[int, str, int | None]], strict: bool = False) -> Attempt:
    """The batch twin: one attempt's events at once."""
    attempt = Attempt(strict=strict)
    for seq, kind, region, *parents in sorted(rows, key=lambda r: r[0]):
        attempt.offer(seq, kind, region, *parents)
    return attempt
