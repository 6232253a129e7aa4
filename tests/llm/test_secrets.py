import hashlib
import random
import re
import string

import numpy as np

from kinweave.llm import rawtext, secrets
from tests.llm.samples import awkward_rows, empty, frame, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def base(text):
    text = text or ""
    found = []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, rule, fits in (("assign", pattern, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rule, text) if fits(m)]
    return [x[2] for x in sorted(found)]


def secret_rows():
    rng = random.Random(5)
    rows = awkward_rows()
    pieces = ['token = "%s"' % "".join(rng.choices("0123456789abcdef", k=40)), "AKIA" + "A1" * 9, "AKIA12", "PASSWORD:'abc'", "Api_Key=abcdef", "apikey: hunter2hunter2",
              "deadbeef" * 4, "passwd == x", 'ſecret="abcdefgh"', "toKen=abcdefgh", "tokentoken=ab-password=abcdef", "é" * 30, "a" * 23, "a" * 24, "SECRET   =   \"abcdefg"]
    for i in range(100, 300):
        seq = []
        for _ in range(rng.randint(1, 6)):
            seq += [rng.choice(pieces), rng.choice(["", " ", "\n", "é", "x"])]
        rows.append((i, "".join(seq), "en", "a", 1))
    return rows


def test_base_counts_and_digest(spark):
    rows = secret_rows()
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan_report(frame(spark, rows, True), VOCABULARY).collect()}
    want = set()
    for i, text, *_ in rows:
        spans = base(text)
        kinds = [s.split(":")[0] for s in spans]
        want.add((i, hashlib.sha256(",".join(spans).encode()).hexdigest(), *(kinds.count(k) for k in ("assign", "access", "hex"))))
    assert got == want
    assert secrets.scan_report(empty(spark), VOCABULARY).count() == 0


def test_random_runs_and_known_forms():
    encoding = secrets._encoding(secrets.load_ranks(VOCABULARY))
    rng = random.Random(2)
    random_runs = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(24, 60))) + "7a" for _ in range(300)]
    hit = sum(secrets.looks_random(r, encoding, 2.2) for r in random_runs)
    assert hit >= 297
    clean = ["getUserNameFromRequest2", "2024-01-31T120000Z", "123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e", "1234567890123456789", "internationalisation-version2", "training_data_pipeline_step_10"]
    assert not any(secrets.looks_random(c, encoding, 2.2) for c in clean)


def test_readable_text_around_a_secret_does_not_hide_it():
    encoding = secrets._encoding(secrets.load_ranks(VOCABULARY))
    rng = random.Random(8)
    alnum, letters, web = string.ascii_letters + string.digits, string.ascii_letters, string.ascii_letters + string.digits + "-_"
    for before, kind, n in (
        ("", alnum, 32), ("deployment/production/service-account/", alnum, 32), ("production_database_connection_string=", alnum, 24),
        ("", letters, 40), ("", string.ascii_lowercase, 40), ("continuous-integration-credentials-", web, 44),
    ):
        caught = 0
        for _ in range(200):
            text = "see " + before + "".join(rng.choices(kind, k=n)) + " there"
            spans = [(a, b) for k, a, b, _ in secrets.secrets_of(text, encoding, 2.2)]
            caught += sum(min(b, len(text) - 6) - max(a, 4 + len(before)) for a, b in spans) >= 0.75 * n
        assert caught >= 0.95 * 200, (before, n, caught)
    clean = [
        "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaften", "AbstractSingletonProxyFactoryBean",
        "XMLHttpRequestEventTarget", "MAXIMUMLENGTHEXCEEDED", "src/main/resources/application-production-v2", "release_1_2_3_4_5_6_7_8_9_10_11",
        "path/to/d41d8cd98f00b204e9800998ecf8427e/Report", "well-known-and-understood", "a" * 60, "----------------------------",
    ]
    for text in clean:
        assert not [x for x in secrets.secrets_of(text, encoding, 2.2) if x[0] == "random"], text


def test_spans_equal_a_plain_search_of_every_text(spark):
    """All spans of every text, also those that the batch filter passes over."""
    rng = random.Random(9)
    encoding = secrets._encoding(secrets.load_ranks(VOCABULARY))
    rows = secret_rows()
    for i in range(400, 480):
        kind = rng.choice([string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase, "ab/_-=1"])
        rows.append((i, rng.choice(["", "é ", "see/", "x_"]) + "".join(rng.choices(kind, k=rng.randint(10, 50))), "en", "a", 1))
    got = sorted((str(r.doc_id), r.spans) for r in secrets.scan_report(frame(spark, rows, True), VOCABULARY).collect())
    want = sorted(
        (str(i), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.secrets_of(text or "", encoding, 2.2))) for i, text, *_ in rows
    )
    assert got == want and sum("random" in spans for _, spans in got) > 30


def test_word_spans_and_hashes_against_plain_python():
    import pyarrow as pa

    texts = [r[1] for r in awkward_rows(4)] + ["a", "b", "", "a", "ab"]
    data, offsets = rawtext.text_buffer(pa.array(texts, pa.string()))
    starts, ends, cuts = rawtext.word_spans(data, offsets)
    raw = data.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(cuts, cuts[1:])] == [words(t) for t in texts]
    hashes = rawtext.span_hashes(data, starts, ends)
    by_word = {}
    for h, a, b in zip(hashes.tolist(), starts, ends):
        by_word.setdefault(raw[a:b], set()).add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len(set().union(*by_word.values())) == len(by_word)
    assert np.array_equal(rawtext.row_sums(np.ones(len(starts)), cuts), np.diff(cuts))
