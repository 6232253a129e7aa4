"""The ordered fold over control events: which events hold, and what each of them closes.

Events act on ids only. A row stream sorted by (component, stage, order) goes through one small
state per component; families are never expanded to their sons here, that is a join afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

FOLD_INPUT = (
    "component string, stage int, kind string, pos bigint, kind_rank int, topic string, "
    "offset bigint, event_id string, ids array<string>, opened_by string, head string, "
    "size bigint, depth int"
)
FOLD_OUTPUT = (
    "component string, fact string, kind string, event_id string, pos bigint, kind_rank int, "
    "topic string, offset bigint, family_id string, opened_by string, parent string, "
    "list_index int, base bigint, head string, size bigint, depth int"
)
_FIELDS = [part.split()[0] for part in FOLD_OUTPUT.split(", ")]


class Genealogy:
    """Live families of one component, by id.

    ``live[id] = (opened_by, head, size, depth)``: the event that opened this version, its first
    son, its number of sons, the height of its merge tree. ``named[id]`` holds those sons whose own
    id matters in the rows at hand.
    """

    def __init__(self, component: str):
        self.component = component
        self.live: dict[str, tuple] = {}
        self.named: dict[str, set] = {}
        self.loaded: list[str] = []
        self.fate: dict[tuple, tuple] = {}
        self.resumed = False

    def fact(self, fact: str, event: dict | None = None, **values) -> tuple:
        row = dict.fromkeys(_FIELDS)
        if event:
            for name in ("kind", "event_id", "pos", "kind_rank", "topic", "offset"):
                row[name] = event[name]
        row.update(values, component=self.component, fact=fact)
        return tuple(row[name] for name in _FIELDS)

    def step(self, event: dict) -> Iterator[tuple]:
        kind = event["kind"]
        if kind == "CREATE":
            own = event["event_id"]
            self.live[own] = (own, own, 1, 0)
            self.named[own] = {own}
            return
        if kind == "FAMILY":
            self.resumed = True
            own = event["event_id"]
            self.live[own] = (event["opened_by"], event["head"], event["size"], event["depth"])
            self.named.setdefault(own, set())
            self.loaded.append(own)
            return
        if kind == "SON":
            self.resumed = True
            self.named.setdefault(event["opened_by"], set()).add(event["event_id"])
            return
        ids = list(event["ids"])
        missing = [(i, name) for i, name in enumerate(ids) if name not in self.live]
        for i, name in missing:
            yield self.fact("MISSING", event, family_id=name, list_index=i)
        if missing or kind == "PROBE":
            return
        yield from (self.merge if kind == "MERGE" else self.split)(event, ids)

    def close(self, event: dict, name: str, **values) -> tuple[tuple, tuple]:
        version = self.live.pop(name)
        opened_by, head, size, depth = version
        self.fate[name, opened_by] = (values.get("parent"), event["event_id"])
        row = self.fact("CLOSE", event, family_id=name, opened_by=opened_by, head=head, size=size,
                        depth=depth, **values)
        return version, row

    def merge(self, event: dict, ids: list[str]) -> Iterator[tuple]:
        new = event["event_id"]
        base, height, head, sons = 0, 0, None, set()
        for i, name in enumerate(ids):
            version, row = self.close(event, name, parent=new, list_index=i, base=base)
            yield row
            head = version[1] if i == 0 else head
            base += version[2]
            height = max(height, version[3])
            joining = self.named.pop(name, set())
            if len(joining) > len(sons):
                sons, joining = joining, sons
            sons |= joining
        self.live[new] = (new, head, base, height + 1)
        self.named[new] = sons
        yield self.fact("OPEN", event, family_id=new, opened_by=new, head=head, size=base,
                        depth=height + 1)

    def split(self, event: dict, ids: list[str]) -> Iterator[tuple]:
        name, by = ids[0], event["event_id"]
        (opened_by, head, size, depth), row = self.close(event, name)
        yield row
        for son in self.named.pop(name, set()):
            if son != head:
                self.live[son] = (by, son, 1, 0)
                self.named[son] = {son}
        self.live[name] = (by, head, 1, 0)
        self.named[name] = {head}
        yield self.fact("OPEN", event, family_id=name, opened_by=opened_by, head=head, size=size,
                        depth=depth)

    def hand_over(self) -> Iterator[tuple]:
        """State for the next block of a large component."""
        for name, (opened_by, head, size, depth) in self.live.items():
            yield self.fact("FAMILY", event_id=name, opened_by=opened_by, head=head, size=size, depth=depth)
        for name, sons in self.named.items():
            for son in sons:
                yield self.fact("SON", event_id=son, opened_by=name)
        first_close: dict[str, tuple] = {}
        for (name, _), fate in self.fate.items():
            first_close.setdefault(name, fate)
        for name in self.loaded:
            if name not in first_close:
                continue
            parent, by = first_close[name]
            while parent is not None and (parent, parent) in self.fate:
                name_now = parent
                parent, by = self.fate[name_now, name_now]
            # parent: the live family that now holds the sons; none: event `by` set them free
            yield self.fact("MOVE", family_id=name, parent=parent, opened_by=None if parent else by)


def fold(hand_over: bool):
    """mapInPandas function over rows sorted by component, stage and order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Genealogy | None = None
        for batch in batches:
            out: list[tuple] = []
            for event in batch.to_dict("records"):
                if state is None or state.component != event["component"]:
                    if state is not None and hand_over:
                        out.extend(state.hand_over())
                    state = Genealogy(event["component"])
                out.extend(state.step(event))
            yield _frame(out)
        if state is not None and hand_over:
            yield _frame(list(state.hand_over()))

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_FIELDS)
    for name in ("pos", "kind_rank", "offset", "list_index", "base", "size", "depth"):
        frame[name] = frame[name].astype("Int64")
    for name in ("component", "fact", "kind", "event_id", "topic", "family_id", "opened_by", "parent", "head"):
        frame[name] = frame[name].astype(object)
    return frame
