"""Small control logs and reports for the tests."""

from __future__ import annotations

import random

from kinweave.schemas import CONTROL, REPORT

from .model import TOPIC, Registry, event_id, uuid_of


def create(pos, sensor, reports_id, data_offset=0, key=None):
    return dict(pos=pos, kind="CREATE", topic="creation", offset=pos, event_key=key or f"{sensor}|{reports_id}|{pos}",
                sourceName=sensor, externalSystemID=reports_id, dataOffset=data_offset)


def merge(pos, ids, key=None):
    return dict(pos=pos, kind="MERGE", topic="merge", offset=pos, event_key=key or f"m{pos}", mergedEntitiesId=list(ids))


def split(pos, family, key=None):
    return dict(pos=pos, kind="SPLIT", topic="split", offset=pos, event_key=key or f"s{pos}", splittedEntityID=family)


def random_control(seed, n_events=60, n_topics=3, n_ids=3, same_pos=True):
    """Creates, nested merges, repeated splits, and events naming dead, unknown or malformed ids."""
    rng = random.Random(seed)
    events, pos = [], 0
    for i in range(n_events):
        pos += rng.choice([0, 1, 2]) if same_pos else 1
        registry = Registry(events)
        live = sorted(registry.live)
        known = sorted({v["family"] for v in registry.versions})
        roll = rng.random()
        if roll < 0.35 or not known:
            e = create(pos, f"t{rng.randrange(n_topics)}", f"x{rng.randrange(n_ids)}", rng.randrange(3) * pos // 3, key=f"c{i}")
        elif roll < 0.7:
            pool = live if rng.random() < 0.8 and live else known + [uuid_of("nobody", str(i)), "not-a-uuid"]
            ids = [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 2, 3, 4]))]
            if rng.random() < 0.8:
                ids = list(dict.fromkeys(ids))
            if rng.random() < 0.2:
                ids = [x.upper() for x in ids]
            e = merge(pos, ids, key=f"m{i}")
        else:
            several = [f for f in live if len(registry.live[f]["sons"]) > 1]
            pool = several if several and rng.random() < 0.6 else known + [uuid_of("nobody", str(i))]
            e = split(pos, rng.choice(pool), key=f"s{i}")
        e["offset"] = i
        events.append(e)
        if rng.random() < 0.03:
            events.append(dict(e, offset=1000 + i, pos=pos + 1))
    return events


def random_reports(seed, n=80, last_pos=70, n_topics=3, n_ids=3):
    """(topic, offset, pos, source name, external id); some name another source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = f"t{rng.randrange(n_topics)}"
        name = topic if rng.random() < 0.7 else f"t{rng.randrange(n_topics)}"
        pos = i * last_pos // n
        rows.append((topic, pos * 10 + i % 10, pos, name, f"x{rng.randrange(n_ids)}"))
    return rows


def control_frame(spark, events):
    names = [f.name for f in CONTROL.fields]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], CONTROL)


def reports_frame(spark, reports):
    """``entityOffset`` is the report's position, so that a son's state tells where it is from."""
    rows = [
        (topic, offset, pos,
         (((4.5, 3.4), False, pos, name), 4.7, 7.8, 8.3, "USA", "boat", "huh?", 6.1, "rerere", ext))
        for topic, offset, pos, name, ext in reports
    ]
    return spark.createDataFrame(rows, REPORT)


__all__ = ["TOPIC", "create", "merge", "split", "event_id", "random_control", "random_reports",
           "control_frame", "reports_frame"]
