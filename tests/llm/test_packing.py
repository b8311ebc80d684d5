import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing

rng = random.Random(6)
enc = packing.encoder(packing.VOCABULARY)


def reference(text):
    return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(st.characters(max_codepoint=0x260), max_size=40), st.text("aB '’sStTdDmMrevl._-#12 \t\n\x0b\xa0\x85\x1c<|>éÉßİıΣσ²½ªº\xad", max_size=40)))
def test_ids_are_the_tokenizers(text):
    assert enc.encode(text) == reference(text)


def test_ids_of_odd_texts():
    for t in ("a<|endoftext|>b", "It'S don't 'sun (('s we'LL", "ŉ ǅ µ", "ΟΔΟΣ ς", "x\x00y", "", " \n"):
        assert enc.encode(t) == reference(t), t


def test_cuts_add_up_and_fit():
    for n in [*range(1, 9000, 7), 4096, 8192, 100_001]:
        out = packing.cut(n)
        assert sum(x for _, x in out) == n and all(0 < x <= packing.CAPACITY // k for k, x in out)
        assert all(x * (1 + packing.SLACK) >= packing.CAPACITY // k - 1 for k, x in out if k < packing.CLASSES)


def test_packing_holds_its_contract(spark, docs):
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 40, 700, 2500])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "z1 " * 9000), (503, "same"), (503, "same"), (None, "null id")]
    got = packing.pack(docs(rows)).toPandas()
    by_seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_seq["length"].sum() <= 4096).all()
    assert ((by_seq["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"]) == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    used = got["length"].sum() / (4096 * got["sequence_id"].nunique())
    assert used > 0.93
    for i, text in rows:
        if i in (None, 503):
            continue
        raw = reference(text or "") + np.array([2], "<u4").tobytes()
        mine = got[got.doc_id == i].sort_values("start")
        assert list(mine["start"]) == list(mine["length"].cumsum() - mine["length"]) and mine["length"].sum() == len(raw) // 4 and (mine["doc_tokens"] == len(raw) // 4).all()
        assert [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(mine["start"], mine["length"])] == list(mine["ids_crc32"])
    assert (got.doc_id == 503).sum() == 2 and got.doc_id.isna().sum() >= 1
    assert packing.pack(docs([])).count() == 0


def test_full_bins_hold_a_fixed_count(spark, docs):
    rows = [(i, "ab " * 1200) for i in range(60)]
    got = packing.pack(docs(rows)).where(f"sequence_id >= {packing.STRIDE}").toPandas()
    k = got["sequence_id"] // packing.STRIDE
    assert (got.groupby("sequence_id").size() == (got.assign(k=k).groupby("sequence_id")["k"].first())).all()
