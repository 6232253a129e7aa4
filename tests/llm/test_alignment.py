import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinweave.llm import alignment
from kinweave.session import materialize
from tests.llm.samples import awkward_rows, empty, frame

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def rows():
    odd = [
        "<|endoftext|> <s> a", "x▁y", "\x00 a\tb\n\n  c   d   ", "é 漢字🙂 naïve", "x" * 3001, "<0x41>", " lead", "naïve naïve", "   x",
    ]
    return awkward_rows() + [(300 + i, t, "en", "a", 1) for i, t in enumerate(odd)]


def brute(texts):
    """Groups by walking both token lists, and evidence over all documents."""
    a_side, b_side = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a_side.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        return bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()

    found = []
    for text in texts:
        groups = []
        if text:
            a, b, whole = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text), (" " + text).encode()
            a_names, b_names = [a_bytes[i] for i in a], list(map(b_bytes, b))
            if b"".join(a_names) == whole == b"".join(b_names):
                a_ends, b_ends = np.cumsum(list(map(len, a_names))).tolist(), np.cumsum(list(map(len, b_names))).tolist()
                i = j = 0
                for end in sorted(set(a_ends) & set(b_ends)):
                    k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
        found.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    held = Counter(p for link in links for p in link)
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for groups, link in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(link.values()),
            sum(n for p, n in link.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in link.items()), text,
        ))
    return out


def test_report_equals_brute_force(spark):
    want = [
        (row[0], *found[:-1], hashlib.sha256(found[-1].encode()).hexdigest() if found[-1] else "")
        for row, found in zip(rows(), brute([row[1] for row in rows()]))
    ]
    got = alignment.alignment_report(frame(spark, rows(), True), A_PATH, B_PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.alignment_report(empty(spark), A_PATH, B_PATH).count() == 0


def test_groups_and_rare_pairs(spark):
    from pyspark.sql import functions as F

    aligned = materialize(
        alignment.align(frame(spark, rows()), A_PATH, B_PATH, block_bytes=5_000).withColumn("row", F.monotonically_increasing_id())
    )
    want = sorted(((row[0], found[-1]) for row, found in zip(rows(), brute([row[1] for row in rows()]))), key=str)
    assert sorted(map(tuple, aligned.select("doc_id", "groups").collect()), key=str) == want
    # nearly all pairs meet their counts in the join, then none
    few, all_ = (
        sorted(map(tuple, alignment.evidence(aligned, "row", frequent=n).collect())) for n in (20, alignment.FREQUENT)
    )
    assert few == all_
    assert any(r[2] for r in few)


@pytest.mark.parametrize("text", [" " * 400_000 + "x", "\n" * 300_000 + " end", "a" * 400_000, "漢" * 50_000])
def test_long_runs(text):
    a, b = alignment.ByteTokenizer(open(A_PATH).read()), alignment.PieceTokenizer(open(B_PATH, "rb").read())
    block = alignment.aligned_block(["x", text, None], a, b, alignment.GroupText(51_000))
    library = Tokenizer.from_file(A_PATH)
    assert block["n_a"].to_pylist()[1] == len(library.encode(" " + text, add_special_tokens=False).ids)
    assert block["n_links"].to_pylist()[1] == sum(block["times"].to_pylist()[1])
    assert block["n_groups"].to_pylist()[1] == block["groups"].to_pylist()[1].count("|")


def test_windows_of_one_hash_stay_apart(monkeypatch):
    a, b = alignment.ByteTokenizer(open(A_PATH).read()), alignment.PieceTokenizer(open(B_PATH, "rb").read())
    text = alignment.GroupText(51_000)
    texts = ["one two three two", "three one naïve été", "two"]
    want = {k: v.to_pylist() for k, v in alignment.aligned_block(texts, a, b, text).items()}
    monkeypatch.setattr(alignment, "mix", lambda values: values * 0)
    monkeypatch.setattr(alignment.Side, "hashes", lambda self, cuts: np.zeros(len(cuts) - 1, np.uint64))
    assert {k: v.to_pylist() for k, v in alignment.aligned_block(texts, a, b, text).items()} == want
