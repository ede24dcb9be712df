import duckdb
import pytest

from tableprep.llm import quality_rules as Q
from tableprep.llm.common import table

from .helpers import CLASHES, awkward, documents, prose

SF = "/root/testdata/sf0.001"


def repeated(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_counts_of_the_generated_documents(spark):
    got = {r["doc_id"]: r for r in Q.base_counts(table(spark, SF, "documents").select("doc_id", "text")).collect()}
    for r in table(spark, SF, "documents").collect():
        t = r["text"] or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"]) == (len(words), sum(map(len, words)))
        assert g["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert g["n_dup_lines"] == len(lines) - len(set(lines))
        assert g["n_repeat_words"] == repeated(words), r["doc_id"]


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 2, ["a"] * 3, ["a"] * 7, list("abcabcab"), list("abcdabc"), list("xabcyabcabc")])
def test_repeated_windows(spark, words):
    df = documents(spark, [(1, "\t".join(words))])
    assert Q.base_counts(df.select("doc_id", "text")).first()["n_repeat_words"] == repeated(words)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    menu = "Home | About us | Contact 2024"
    rows = [(i, f"{menu}\n{prose(70, i)}", "hot") for i in range(40)]
    rows += [(100 + i, f"HOME  | about us | contact 19{i:02d}\n" * 20 + prose(5, 7 * i), "hot") for i in range(3)]
    rows += [(200, f"{menu}\n{prose(70, 3)}", "rare")] + [(300 + i, prose(90, 1), "hot") for i in range(60)]    # copies are one document
    limits = Q.LineLimits(max_share=0.5, min_docs=20)
    got = {r["doc_id"]: r for r in Q.quality_rules(documents(spark, rows), limits).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 7 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(3))
    assert got[200]["n_removed_words"] == 0 and all(got[300 + i]["kept"] for i in range(60))
    kept = {r["doc_id"]: r["text"] for r in Q.kept_documents(documents(spark, rows, ("kept", "w")), limits).collect()}
    assert kept[0] == prose(70, 0) and kept[200].startswith(menu) and 100 not in kept


def test_frequent_lines_of_hot_and_small_hosts(spark):
    from corpus_pipeline import quality

    own = lambda i: " ".join(f"{i}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(60))
    rows = [(i, f"{own(i)}\nshare this page" if i < 110 else f"{own(i)}\nseldom said" if i < 200 else own(i), "hot") for i in range(1500)]
    rows += [(2000 + i, f"all rights reserved 20{i:02d}\n{own(2000 + i)}" + ("\nfour of twelve" if i < 4 else ""), "small") for i in range(12)]
    left = {r["doc_id"]: r["text"] for r in quality(spark, documents(spark, rows), "").collect()}
    assert len(left) == len(rows)
    assert all(left[i] == own(i) for i in range(110))       # 110 documents, but only 7 % of the host
    assert all(left[i].endswith("seldom said") for i in range(110, 200))
    assert all(left[2000 + i] == own(2000 + i) + ("\nfour of twelve" if i < 4 else "") for i in range(12))     # fewer than 20 documents


def test_awkward_rows(spark):
    df = documents(spark, awkward(), CLASHES)
    got = Q.quality_rules(df).collect()
    assert len(got) == len(awkward())
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0} and not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert sum(r["kept"] for r in got if r["doc_id"] == 5) == 2
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == 5    # the long text repeats itself
    assert Q.quality_rules(df.limit(0)).count() == 0 and Q.kept_documents(df.limit(0)).count() == 0


def test_null_host_is_a_host(spark):
    rows = [(i, f"same line here\n{prose(60, i)}", None) for i in range(30)] + [(50, f"same line here\n{prose(60, 50)}", "-")]
    got = {r["doc_id"]: r["n_removed_words"] for r in Q.quality_rules(documents(spark, rows)).collect()}
    assert got[0] == 3 and got[50] == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(Q.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = Q.op10_line_frequency(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(got)].astype(str))
