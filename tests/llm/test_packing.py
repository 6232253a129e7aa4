import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from kinweave.llm import packing, secrets
from tests.llm.samples import awkward_rows, empty, frame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_best_fit_decreasing_equals_linear_search():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.randint(5, 60)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        rows, room = [], []
        for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in range(len(rows)) if room[r] >= lengths[piece]]
            if fits:
                row = min(fits, key=lambda r: room[r])
            else:
                row = len(rows)
                rows.append([])
                room.append(size)
            rows[row].append(piece)
            room[row] -= lengths[piece]
        got = packing.best_fit_decreasing(np.array(lengths, np.int64), size)
        assert sorted(p for r in got for p in r) == list(range(len(lengths)))
        assert sorted(sum(lengths[p] for p in r) for r in got) == sorted(size - x for x in room)
    assert packing.RoomTree(8).take(3) is None


def unpacked(rows, size):
    """Documents put together again from the packed rows."""
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<i4")
        assert len(ids) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= size
        place = packing.positions(r.cu_seqlens, r.position_resets, size)
        for a, b, first, doc, part in zip(r.cu_seqlens, r.cu_seqlens[1:], r.position_resets, r.doc_ids, r.parts):
            assert first == part * size and place[a] == first and place[b - 1] == first + b - a - 1
            pieces.setdefault(doc, []).append((part, ids[a:b].tolist()))
    return pieces


def test_round_trip(spark):
    rows = [(i, t, *rest) for i, t, *rest in awkward_rows()]
    plain = encoding()
    for size, block in ((packing.ROW, packing.BLOCK_TOKENS), (64, 500)):
        packed = packing.pack(frame(spark, rows, True), VOCABULARY, size=size, block_tokens=block).collect()
        assert len({r.pack_id for r in packed}) == len(packed)
        pieces = unpacked(packed, size)
        want = {}
        for i, text, *_ in rows:
            ids = [*plain.encode_ordinary(text or ""), packing.END_ID]
            want.setdefault(i, []).extend((p, ids[a:b]) for p, (a, b) in enumerate(packing.split(len(ids), size)))
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_pre_tokens_cut_like_the_vocabulary(spark):
    plain, own = encoding(), packing.Tokenizer(secrets.load_ranks(VOCABULARY))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()[:80]:
        text = r.text + "  trailing \n\n it's  we'LL 12ab ²½ 　x"
        assert own.ids(text).tolist() == plain.encode_ordinary(text)


def test_rows_are_nearly_full(spark, tmp_path):
    packed = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCABULARY)
    packing.write_packed(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed")).select("n_ids").collect()
    assert sum(r.n_ids for r in back) > 0.98 * packing.ROW * (len(back) - 8)
