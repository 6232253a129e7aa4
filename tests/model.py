"""An independent model of the family rules, one event after the other, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

UUID = re.compile("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
RANK = {"CREATE": 0, "MERGE": 1, "SPLIT": 2}
TOPIC = {"CREATE": "creation", "MERGE": "merge", "SPLIT": "split"}


def uuid_of(*parts):
    h = hashlib.md5("|".join(parts).encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def event_id(event):
    return uuid_of(TOPIC[event["kind"]], event["event_key"])


class Registry:
    """Versions with their sons, refused events with reason and missing ids."""

    def __init__(self, control):
        self.sources = {}
        self.live = {}
        self.versions = []
        self.rejected = {}
        seen = set()
        order = sorted(control, key=lambda e: (e["pos"], RANK[e["kind"]], TOPIC[e["kind"]], e["offset"]))
        for event in order:
            if event_id(event) in seen:
                self.rejected[event["pos"], event["offset"], event["kind"]] = ("DUPLICATE_EVENT", [])
                continue
            seen.add(event_id(event))
            getattr(self, event["kind"].lower())(event)

    def open(self, family, state, pos, sons):
        seq = 1 + sum(v["family"] == family for v in self.versions)
        version = dict(family=family, seq=seq, state=state, v_from=pos, v_to=None, sons=sons)
        self.versions.append(version)
        self.live[family] = version

    def close(self, family, pos):
        version = self.live.pop(family)
        version["v_to"] = pos
        return version["sons"]

    def refuse(self, event, reason, missing=()):
        self.rejected[event["pos"], event["offset"], event["kind"]] = (reason, list(missing))

    def create(self, event):
        own = event_id(event)
        self.sources[own] = (event["sourceName"], event["externalSystemID"], event["dataOffset"])
        self.open(own, "NONE", event["pos"], [own])

    def check(self, event, ids):
        ids = [i.lower() for i in ids]
        if not all(UUID.match(i) for i in ids):
            return self.refuse(event, "MALFORMED_ID")
        if not ids:
            return self.refuse(event, "EMPTY_LIST")
        if len(set(ids)) < len(ids):
            return self.refuse(event, "DUPLICATE_ID")
        missing = [i for i in ids if i not in self.live]
        if missing:
            return self.refuse(event, "UNKNOWN_ID", missing)
        return ids

    def merge(self, event):
        ids = self.check(event, event["mergedEntitiesId"])
        if ids:
            sons = [son for i in ids for son in self.close(i, event["pos"])]
            self.open(event_id(event), "MERGED", event["pos"], sons)

    def split(self, event):
        ids = self.check(event, [event["splittedEntityID"]])
        if ids:
            first, *others = self.close(ids[0], event["pos"])
            self.open(ids[0], "SON_TAKEN", event["pos"], [first])
            for son in others:
                self.open(son, "WAS_SPLIT", event["pos"], [son])

    def rows(self):
        return sorted(
            (v["family"], v["seq"], v["state"], v["v_from"], v["v_to"], len(v["sons"]), i, son, *self.sources[son])
            for v in self.versions for i, son in enumerate(v["sons"])
        )


def records(registry, reports, mode, seeds):
    """Family records per accepted report, and the dead letters.

    A report is (topic, offset, pos, source name, external id); what a son knows is the position of
    the report it comes from.
    """
    out, dead = [], []
    ends = {}
    previous = {}
    for v in registry.versions:
        known = {}
        for son in v["sons"]:
            before = previous.get(son)
            known[son] = None
            if before is not None:
                state, told = ends[id(before)]
                if seeds == "own" and before["family"] == son:
                    known[son] = told.get(son)
                if seeds == "carry":
                    known[son] = state.get(son)
            previous[son] = v
        told, first = {}, True
        inputs = []
        for topic, offset, pos, name, ext in reports:
            for i, son in enumerate(v["sons"]):
                sensor, reports_id, data_offset = registry.sources[son]
                if (topic, ext) != (sensor, reports_id) or offset < data_offset:
                    continue
                if v["v_to"] is not None and pos >= v["v_to"]:
                    continue
                if mode == "resume" and pos < v["v_from"]:
                    continue
                inputs.append((pos, topic, offset, i, name, ext))
        for pos, topic, offset, i, name, ext in sorted(inputs):
            reporter = next((s for s in v["sons"] if registry.sources[s][:2] == (name, ext)), None)
            if reporter is None:
                dead.append((v["family"], v["seq"], pos, topic, offset))
                continue
            known[reporter] = told[reporter] = pos
            out.append((v["family"], v["seq"], pos, topic, offset, i, reporter, v["state"] if first else "NONE",
                        tuple((s, known[s]) for s in v["sons"])))
            first = False
        ends[id(v)] = (dict(known), told)
    return sorted(out), sorted(dead)


def group_by(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    return groups
