import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tessera.llm import sentencepieces as sp

rng = random.Random(2)
v = sp.vocabulary()


def total(ids):
    """The sum of scores of an encoding, bytes as the unknown characters that they spell."""
    score, run = 0.0, bytearray()
    for i in [*np.frombuffer(ids, "<u4").tolist(), -1]:
        if i in v.bytes:
            run.append(v.bytes[i])
            continue
        score += v.unknown * len(run.decode("utf-8", "surrogatepass"))
        run = bytearray()
        if i >= 0:
            score += v.score[v.pieces[i]][1]
    return score


def brute(text):
    """Best total by a table over all places, without words, prefixes or chunks."""
    best = [0.0] + [sp.NONE] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            p = text[i:j]
            s = v.score[p][1] if p in v.score else v.unknown if j == i + 1 else None
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def chunked(text, size, slack):
    parts = list(sp.chunks_of(text, size, v.longest - 1, slack))
    states = sp.scan([sp.transfer(v, c, n) for _, n, c in parts])
    return b"".join(sp.trace_chunk(v, c, n, a, b) for (_, n, c), a, b in zip(parts, states, states[1:]))


ODD = st.text(st.sampled_from(list("the inagof,.▁ \n\t12é漢ß#*😀aaa")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_best_path_and_round_trip(text):
    norm = v.normalise(text)
    ids = v.encode(norm)
    assert total(ids) == brute(norm)
    assert v.decode(np.frombuffer(ids, "<u4")) == text.replace(sp.BLANK, " ")


@settings(max_examples=200, deadline=None)
@given(ODD, st.integers(1, 40))
def test_chunks_reach_the_same_total(text, size):
    norm = v.normalise(text)
    ids = chunked(norm, size, 0)
    assert total(ids) == brute(norm) and v.decode(np.frombuffer(ids, "<u4")) == text.replace(sp.BLANK, " ")


def test_chunks_cut_at_words_give_the_same_ids():
    text = v.normalise(" ".join("".join(rng.choices(["the", "in", "er", "ation", "q", "é"], k=rng.randrange(1, 6))) for _ in range(800)))
    for size in (60, 300, 1000):
        assert chunked(text, size, 50) == v.encode(text)


def test_product_is_associative():
    g = np.random.default_rng(0)
    a, b, c = (np.where(g.random((6, 6)) < 0.3, sp.NONE, g.integers(-50, 0, (6, 6)).astype(float)) for _ in range(3))
    assert (sp.product(sp.product(a, b), c) == sp.product(a, sp.product(b, c))).all()
    m = [g.integers(-50, 0, (6, 6)).astype(float) for _ in range(13)]
    step, want = m[0], [m[0]]
    for x in m[1:]:
        step = sp.product(step, x)
        want.append(step)
    assert all((x == y).all() for x, y in zip(sp.prefix_products(m), want))


def test_the_library_finds_the_same_ids():
    """The library's own unigram search over this vocabulary, with the scores of blank runs that Vocabulary sets, on texts it can hold exactly."""
    proto = model_pb2.ModelProto()
    with open(sp.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        if p.type in (sp.NORMAL, sp.USER_DEFINED):
            p.score = v.score[p.piece][1]
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for _ in range(60):
        text = " ".join("".join(rng.choices(["the", "in", "er", "ation", "ou", "st", "é", ",", "."], k=rng.randrange(1, 6))) for _ in range(20))
        assert np.frombuffer(v.encode(v.normalise(text)), "<u4").tolist() == lib.encode(text), text


def test_documents_short_and_giant(spark, docs):
    giant = " ".join("".join(rng.choices(["the", "in", "er", "ation", "漢", "\n"], k=3)) for _ in range(3000))
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, giant), (5, "x" * 9000), (6, "  two  blanks "), (4, giant), (None, "null id")]
    enc = sp.encode(docs(rows), chunk=500)
    got = enc.collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        norm = v.normalise(text)
        assert r["n_chars"] == len(text) and r["n_ids"] * 4 == len(r["ids"] or b"")
        assert total(r["ids"]) == total(v.encode(norm))
        if r["doc_id"] != 5:
            assert bytes(r["ids"]) == v.encode(norm)
    back = {r["doc_id"]: r["text"] for r in sp.decode(enc).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert sp.encode(docs([])).count() == 0


def test_query_digests(spark, tmp_path, docs):
    rows = [(1, "The cat sat."), (2, None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in sp.op2_sentencepiece(spark, str(tmp_path)).collect()}
    assert got[1]["text_crc32"] == zlib.crc32(b"The cat sat.") and got[2]["n_ids"] == 0
    assert got[1]["ids_crc32"] == zlib.crc32(v.encode(v.normalise("The cat sat.")))


def test_words_hold_all_pieces():
    for p in v.score:
        assert v.words(p) == [p] or set(p) == {sp.BLANK}, p
    with pytest.raises(FileNotFoundError):
        sp.Vocabulary("/nowhere/model")
