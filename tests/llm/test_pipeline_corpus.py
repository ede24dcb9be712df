"""The pipeline over planted documents, held against brute-force stages and the ids that must remain."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tableprep.llm import packing

from .helpers import documents
from .test_decontaminate import plain as leaked
from .test_quality_rules import repeated

SECRET = "password = hunter22xyz"
ITEM = "which small plant opens its seven white flowers only after the last summer rain has left the northern hills behind"


def own(seed, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def changed(words, *at):
    return [f"{w}x" if i in at else w for i, w in enumerate(words)]


def planted():
    """(id, text, host) rows and what must remain of them."""
    rows = [(i, " ".join(own(i)), f"h{i}") for i in range(12)]
    stay = {i: t for i, t, _ in rows}
    rows += [(20, rows[0][1], "copy"), (21, " ".join(changed(own(1), 60)), "near"), (22, " ".join(changed(own(21), 3)), "far"),
             (23, " ".join(changed(own(1), 60, 100)), "chain")]
    stay[22] = rows[14][1]
    half = " ".join(own(2)[:60] + own(400)[:60])        # half a copy isn't one
    rows.append((24, half, "half"))
    stay[24] = half
    item = ITEM.split()
    for i, said in enumerate([item, changed(item, 4, 9, 13), [*own(50)[:3], *item[3:16]], item[:7]]):
        text = " ".join([*own(30 + i)[:60], *said, *own(40 + i)[:60]])
        rows.append((30 + i, text, "bench"))
        if i == 3:
            stay[33] = text         # seven tokens are no leak
    codes = [SECRET, base64.b64encode(f"this file says {SECRET}".encode()).decode(), base64.b64encode(SECRET.encode("utf-16-le")).decode()]
    for i, code in enumerate(codes):
        text = " ".join([*own(60 + i), "{}", *own(70 + i)])
        rows.append((60 + i, text.format(code), f"secret{i}"))
        stay[60 + i] = text.format("[assign removed]")
    rows += [(80, " ".join(own(80)[:49]), "junk"), (81, "again and again " * 60, "junk"), (82, None, "junk"), (83, "", None)]
    footer = "Imprint and contact 2024"
    for i in range(15):
        rows.append((100 + i, "\n".join([" ".join(own(100 + i)), footer]), "site"))
        stay[100 + i] = " ".join(own(100 + i))
    rows.append((120, "\n".join([" ".join(own(120)[:30]), *[footer] * 20]), "site"))        # depleted
    rows.append((121, "\n".join([" ".join(own(121)), footer]), "other"))
    stay[121] = rows[-1][1]
    return rows, stay


def lines_of(text):
    return (text or "").split("\n")


def normal(line):
    return "".join("0" if c.isdigit() else c for c in " ".join(line.lower().split()))


def quality(rows):
    hosts, seen = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t or "")
        for x in lines_of(t):
            if x.split():
                seen[h, normal(x)].add(t)
    often = {(h, x) for (h, x), ts in seen.items() if len(ts) >= 100 or len(ts) >= 5 and len(ts) > 0.1 * len(hosts[h])}
    out = []
    for i, t, h in rows:
        words = (t or "").split()
        gone = [x for x in lines_of(t) if (h, normal(x)) in often]
        if len(words) >= 50 and 2 * repeated(words) <= len(words) and 2 * sum(len(x.split()) for x in gone) <= len(words):
            out.append((i, "\n".join(x for x in lines_of(t) if (h, normal(x)) not in often), h))
    return out


def near(rows):
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, t, _ in rows for w in [t.split()]}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [r for r in rows if top(r[0]) == r[0]]


def test_planted_documents_through_the_pipeline(spark, tmp_path):
    rows, stay = planted()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, " ".join(own(900, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = near(quality(rows))
    bad = {i for i, _ in leaked([r[:2] for r in clean], [(1, ITEM)])}
    assert {i for i, _, _ in clean} - bad == set(stay) and bad == {30, 31, 32}

    pieces = defaultdict(list)
    room = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        room[r["sequence_id"]] += r["length"]
    assert set(pieces) == set(stay) and max(room.values()) <= packing.Limits().tokens
    enc = packing.encoder(packing.default_path()).full
    for i, text in stay.items():
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*enc.encode(text, add_special_tokens=False).ids, 0], i


def test_stages_keep_rows_that_nothing_speaks_against(spark, tmp_path):
    rows, stay = planted()
    docs = documents(spark, [r for r in rows if r[0] < 12])
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = {r["doc_id"]: r["text"] for r in stage(spark, docs, str(tmp_path)).collect()}
        assert got == {i: stay[i] for i in range(12)}, name


def test_empty_documents_and_null_ids(spark, tmp_path):
    """An empty table gives no sequences; rows without an id, or with one that stands for two texts, go through as documents."""
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(own(300 + i)) for i in range(3)]
    df = documents(spark, [(None, texts[0], "a"), (None, texts[0], "a"), (None, texts[1], None), (5, texts[2], "c"), (5, " ".join(own(310)), "c")])
    for name, rows, want in (("none", df.limit(0), []), ("some", df, [None, None, 5, 5])):
        path = f"{tmp_path}/{name}"
        rows.write.parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path)
        assert sorted((r["doc_id"] for r in got.where("start = 0").collect()), key=lambda x: x or 0) == want
