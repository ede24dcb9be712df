import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import packing as P
from tableprep.llm.common import table

from .helpers import CLASHES, awkward, documents

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b \n c\n d \n\n  e", "<|endoftext|> x  y", "it's 12 o'clock\t\tz", " \n", "x y 　z", "日本語 テキスト é",
         "don't  stop\r\n\r\n now 1234567 !!??", "\x00 \x1f", "👩‍👩‍👧 👍"]


def test_ids_are_those_of_the_tokenizer(spark):
    enc = P.encoder(P.default_path())
    texts = TEXTS + [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    want = [x.ids for x in enc.full.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.batch(texts)] == want
    assert [np.frombuffer(enc(t), "<u4").tolist() for t in texts[:30]] == want[:30]


@pytest.mark.parametrize("limits", [P.Limits(), P.Limits(tokens=64, segments=3, loss=40, pool=16), P.Limits(cut=False), P.Limits(tokens=10, segments=1, loss=10, pool=2)])
@pytest.mark.parametrize("masked", [False, True])
def test_limits_hold_and_every_token_is_placed_once(limits, masked):
    rng = np.random.default_rng(3)
    sizes = [0, 1, 1, *rng.integers(1, 3000, 300).tolist(), 1024, 2048]
    loss = [np.sort(rng.choice(n, n // 2, replace=False)) if masked else None for n in sizes]
    packer, rows = P.Packer(limits), []
    for i, (n, x) in enumerate(zip(sizes, loss, strict=True)):
        rows += packer.add(i, n, x)
    rows += packer.flush()
    seqs: dict = {}
    for k, start, n, q, at in rows:
        seqs.setdefault(q, []).append((at, k, start, n))
    full = 0
    for pieces in seqs.values():
        end = 0
        for at, k, start, n in sorted(pieces):
            assert at == end
            end += n
        full += end
        bearing = sum(n if loss[k] is None else int(((loss[k] >= start) & (loss[k] < start + n)).sum()) for _, k, start, n in pieces)
        alone = not limits.cut and len(pieces) == 1
        assert alone or end <= limits.tokens and len(pieces) <= limits.segments and bearing <= limits.loss
    for i, n in enumerate(sizes):
        at = 0
        for start, size in sorted((s, m) for k, s, m, _, _ in rows if k == i):
            assert start == at
            at += size
        assert at == n
    if limits == P.Limits() and not masked:
        assert len(seqs) * 1024 - full < 2048


def test_query_against_the_tokenizer(spark):
    full = P.encoder(P.default_path()).full
    ids = {r["doc_id"]: full.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table(spark, SF, "documents").collect()}
    got, seqs = {k: 0 for k in ids}, {}
    for r in sorted(P.op7_vector_packing(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        mine = ids[r["doc_id"]]
        assert r["start"] == got[r["doc_id"]] and r["doc_tokens"] == len(mine)
        part = mine[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        got[r["doc_id"]] += r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {k: len(v) for k, v in ids.items()}
    sizes = []
    for x in seqs.values():
        assert [at for at, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))]
        sizes.append(sum(n for _, n in x))
    assert max(sizes) <= 1024 and sum(n < 1024 for n in sizes) <= 3


def test_awkward_rows(spark):
    df = documents(spark, awkward(), (*CLASHES, "length", "ids", "sequence_id"))
    got = P.pack(df, P.default_path()).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] in (1, 2)] == [(1, 1)] * 2
    assert sum(r["start"] == 0 for r in got) == df.count()
    assert P.pack(df.limit(0), P.default_path()).count() == 0


def test_the_pool_holds_no_placed_tokens():
    """2,000 texts of 100,100 tokens: what waits is what is left of each."""
    trim = lambda k, start: (k[0], start, k[2][4 * (start - k[1]):])
    packer, most = P.Packer(P.Limits(), trim), 0
    for i in range(2000):
        for k, start, n, _, _ in packer.add((i, 0, bytes(4 * 100_100)), 100_100):
            assert len(k[2]) // 4 >= start - k[1] + n
        most = max(most, sum(len(x[0][2]) for x in packer.items))
    assert 0 < most < 50_000_000 and all(len(x[0][2]) == 4 * x[2] and x[0][1] == x[1] for x in packer.items)


def test_loss_spans_of_chat_windows(spark):
    """The third limit counts the tokens of the spans that operator 9 writes."""
    from tableprep.llm import chat

    windows = chat.format_windows(table(spark, SF, "conversations").select("conv_id", "turn", "role", "text"))
    windows = windows.select("conv_id", "formatted", "loss").limit(300)
    limits = P.Limits(tokens=512, segments=8, loss=60)
    got = P.pack(windows, P.default_path(), limits, id_col="conv_id", text="formatted", loss="loss").collect()
    full, want = P.encoder(P.default_path()).full, 0
    for r in windows.collect():
        e = full.encode(r["formatted"], add_special_tokens=False)
        spans = [(x["start"], x["start"] + x["length"]) for x in r["loss"]]
        want += sum(any(max(a, s) < min(z, t) for s, t in spans) for a, z in e.offsets)
        want += any(t == len(r["formatted"]) for _, t in spans)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["loss_tokens"] for r in got) == want > 0
    for x in by.values():
        assert sum(r["length"] for r in x) <= 512 and len(x) <= 8 and sum(r["loss_tokens"] for r in x) <= 60
    plain = P.pack(windows.withColumn("loss", F.lit(None).cast("array<struct<start:int,length:int>>")), P.default_path(), limits, id_col="conv_id", text="formatted", loss="loss")
    assert plain.agg(F.sum("loss_tokens")).first()[0] == 0
