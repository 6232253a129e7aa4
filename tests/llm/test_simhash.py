import random
import time

import numpy as np
import pytest
import xxhash

from kinweave.llm import simhash
from tests.llm.samples import awkward_rows, empty, frame, lowered, words


def fingerprint(text):
    seq = words(lowered(text))
    grams = [" ".join(seq[i: i + 4]) for i in range(max(1, len(seq) - 3))] if seq else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(prints):
    """Smallest non-null id reachable over links of four bits, by brute force."""
    n, seen, out = len(prints), set(), {}
    for start in range(n):
        if start in seen:
            continue
        group, stack = [], [start]
        seen.add(start)
        while stack:
            a = stack.pop()
            group.append(a)
            for b in range(n):
                if b not in seen and (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                    seen.add(b)
                    stack.append(b)
        low = min((prints[a][0] for a in group if prints[a][0] is not None), default=None)
        out |= {a: low for a in group}
    return [out[a] for a in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_report_equals_brute_force(spark, clash):
    rows = awkward_rows()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in
                  simhash.near_duplicate_report(frame(spark, rows, clash)).collect()), key=str)
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints))), key=str)
    assert got == want
    assert simhash.near_duplicate_report(empty(spark)).count() == 0


def test_links_keep_every_component(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = set(centres) | {0, 2**64 - 1, 1 << 63}
    for c in centres:
        for _ in range(25):
            p = c
            for b in rng.sample(range(64), rng.randint(0, 9)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    parent = {s[0]: s[0] for s in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4
        parent[root(r.u)] = root(r.v)
    want = components([(i, p) for i, p in enumerate(prints)])
    groups = {}
    for (s,), c in zip(signed, want):
        groups.setdefault(root(s), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_one_of_each_group_stays(spark):
    rows = awkward_rows()
    kept = simhash.one_of_each(frame(spark, rows)).collect()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    low = components(prints)
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in low if c is not None})
    assert ids.count(None) == len({p for (i, p), c in zip(prints, low) if c is None})
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_near_copies_without_id_leave_one_row(spark):
    rng = random.Random(21)
    base = ["v%d" % rng.randrange(10**6) for _ in range(400)]
    texts = [" ".join(base[:k] + ["x%d" % k] + base[k + 1:]) for k in range(0, 400, 40)] + ["something else altogether " * 3]
    low = components([(i, fingerprint(t)) for i, t in enumerate(texts)])
    prints = {fingerprint(t) for t in texts}
    assert len(set(low)) < len(prints)
    kept = simhash.one_of_each(frame(spark, [(None, t, "en", "a", 1) for t in texts])).collect()
    assert len(kept) == len(set(low)) == len({low[texts.index(r.text)] for r in kept})


def groups_of(prints, links):
    """The lowest print each one is joined to."""
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((root(int(u)), root(int(v))))
        parent[b] = a
    return {p: root(p) for p in parent}


def near_pairs(prints):
    for at, p in enumerate(prints):
        for other in prints[at + 1:][np.bitwise_count((prints[at + 1:] ^ p).view(np.uint64)) <= 4]:
            yield p, other


@pytest.mark.parametrize("free_bits,n", [(43, 8000), (22, 4000), (14, 4000)])
def test_crowded_keys_lose_no_link(free_bits, n):
    rng = random.Random(free_bits)
    shared = (rng.getrandbits(64) >> free_bits) << free_bits
    prints = {shared | rng.getrandbits(free_bits) for _ in range(n)}
    for p in rng.sample(sorted(prints), len(prints) // 10):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
    prints = np.array(sorted(prints), np.uint64).view(np.int64)
    assert len(prints) > simhash.DIRECT
    found = simhash.forest(prints)
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in found)
    want = groups_of(prints, near_pairs(prints))
    assert groups_of(prints, found) == want
    assert len(found) == len(prints) - len(set(want.values()))


def test_fifty_thousand_prints_under_one_key():
    rng = random.Random(5)
    prints = sorted({rng.getrandbits(43) << 21 for _ in range(50_000)})
    prints += [p ^ 0b11 << 40 for p in prints[:500]]
    start = time.time()
    found = simhash.forest(np.array(prints, np.uint64).view(np.int64))
    assert time.time() - start < 10
    assert len(found) >= 500


def test_an_id_of_two_texts_keeps_both_groups(spark):
    unlike = ["one text about rivers and their long ways to the sea " * 4, "another text on prices of grain in old towns " * 4]
    rows = [(1, unlike[0], "en", "a", 1), (1, unlike[1], "en", "a", 1), (2, unlike[0], "en", "a", 1), (3, unlike[1], "en", "a", 1),
            (1, unlike[0], "en", "a", 1), (None, unlike[0], "en", "a", 1)]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows, clash=True)).collect()]
    assert sorted(kept) == sorted((1, t) for t in unlike)
