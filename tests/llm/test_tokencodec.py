from __future__ import annotations

import lzma

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import textvec
from inkwell.llm import tokencodec as C

V = 50256


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, V - 1), st.integers(0, 3)), max_size=200), max_size=4))
def test_round_trip(blocks):
    blocks = [np.array(b, np.uint16) for b in blocks if b]
    raw = C.encode(blocks, V)
    assert len(raw) == len(blocks)
    for ids, got in zip(blocks, C.decode_all(raw, [len(b) for b in blocks], V)):
        assert (got == ids).all()


def test_long_block_and_compression():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.4, 9000), V - 1).astype(np.uint16)
    same = np.tile(np.arange(50, dtype=np.uint16), 100)
    raw = C.encode([ids, same], V)
    assert (C.decode(raw[0], len(ids), V) == ids).all()
    assert (C.decode(raw[1], len(same), V) == same).all()
    assert len(raw[0]) < len(ids) * 1.5
    assert len(raw[1]) < len(same) * 0.6


def test_the_mixture_is_a_distribution():
    """The intervals of all ids, one after another, fill the range, by the definition."""
    rng = np.random.default_rng(1)
    past, v = rng.integers(0, 40, 300), 50
    freq = np.array([C.model(np.append(past, x).astype(np.uint16), v)[0][-1] for x in range(v)])
    cum = np.array([C.model(np.append(past, x).astype(np.uint16), v)[1][-1] for x in range(v)])
    assert (freq > 0).all()
    assert cum[0] == 0 and (cum[1:] == cum[:-1] + freq[:-1]).all()
    assert C.TOTAL - 4 <= cum[-1] + freq[-1] <= C.TOTAL


def test_fewer_bits_than_general_compressors():
    tok = C.tokenizer(C.VOCABULARY)
    texts = pa.array(__import__("pyarrow.parquet", fromlist=["x"]).read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist())
    ids = np.concatenate([tok.rows(buf, off)[0] for _, _, buf, off in textvec.slices(texts)])[: 8 * C.BLOCK]
    blocks = np.split(ids, 8)
    raw = C.encode(blocks, tok.size)
    assert sum(map(len, raw)) < 0.98 * sum(len(lzma.compress(b.tobytes())) for b in blocks)
    assert all((a == b).all() for a, b in zip(blocks[:3], C.decode_all(raw[:3], [C.BLOCK] * 3, tok.size)))


def test_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(C.Tokenizer, "MOST", 64)
    tok = C.Tokenizer()
    for k in range(6):  # forgets when full; with more different pieces than it holds it goes without
        text = " ".join(f"word{i * 7 + k}" for i in range(10 if k % 2 else 60)) + " the the"
        buf = np.frombuffer(text.encode(), np.uint8)
        assert tok.rows(buf, np.array([0, len(buf)]))[0].tolist() == tok.encode(text)


def test_damage_raises(spark):
    d = spark.createDataFrame([(i, f"some text number {i} to code in a block") for i in range(40)], "doc_id long, text string").coalesce(1)
    w = C.write_blocks(d, block=100)
    rows = w.collect()
    assert len(rows) > 2
    raw = bytearray(rows[1].payload)
    raw[len(raw) // 2] ^= 0x40
    for bad in (bytes(raw), rows[1].payload[:-20], b"", None):
        broken = spark.createDataFrame([r if k != 1 else (*r[:6], bad, r[7]) for k, r in enumerate(rows)], w.schema)
        with pytest.raises(Exception, match="checksum is wrong|part is missing"):
            C.read_blocks(broken).collect()


def test_pieces_give_the_tokenizers_ids():
    tok = C.tokenizer(C.VOCABULARY)
    texts = ["", " ", "a b", " a  b\n\nc \n d", "don't stop.\nNext line", "é à – x　y z", "tab\tx \r\n y", "中文 字 a", "a" * 3000, "x   "]
    for _ in range(2):
        for lo, hi, buf, off in textvec.slices(pa.array(texts)):
            ids, first = tok.rows(buf, off)
            for k in range(hi - lo):
                assert ids[first[k] : first[k + 1]].tolist() == tok.encode(texts[lo + k])


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'.1 \n\té –　 中")), max_size=25))
def test_cuts_never_change_ids(text):
    tok = C.tokenizer(C.VOCABULARY)
    for _, _, buf, off in textvec.slices(pa.array([text])):
        assert tok.rows(buf, off)[0].tolist() == tok.encode(text)


def test_table_round_trip_and_awkward_rows(spark):
    rows = [(1, "Hello there.\nA line"), (1, "Hello there.\nA line"), (None, "no id"), (2, None), (3, ""), (4, "long text " * 4000)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, payload string").withColumn("block", F.lit("clash"))
    w = C.write_blocks(d.coalesce(1), block=3000)
    back = {}
    for r in sorted(C.read_blocks(w).collect(), key=lambda r: r.start):
        back.setdefault(r.doc_id, []).append(r)
    tok = C.tokenizer(C.VOCABULARY)
    assert sum((r.ids for r in back[4]), []) == tok.encode(rows[5][1])
    assert [r.ids for r in back[1]] == [tok.encode(rows[0][1])] * 2
    assert back[None][0].ids == tok.encode("no id")
    assert set(back) == {1, 4, None}
    assert C.write_blocks(d.limit(0)).count() == 0


def test_checksum(spark):
    d = spark.createDataFrame([(1, "some text to code in a block")], "doc_id long, text string")
    w = C.write_blocks(d).withColumn("checksum", F.col("checksum") + 1)
    with pytest.raises(Exception, match="checksum"):
        C.read_blocks(w).collect()
