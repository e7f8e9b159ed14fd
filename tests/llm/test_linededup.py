import duckdb
import pytest

from vidcohort.llm import linededup as ld

PASSAGE = "One two three four five six seven. " * 2 + " ".join(f"word{i}" for i in range(30)) + "."


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in ld.op8_linededup(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(ld.ORACLE_SQL).fetchall())
    assert sum(r[2] for r in got) > 0


def brute(rows, run_words):
    """Kept texts by plain rules, for distinct ids in order."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        at, parts = 0, []
        for end in ld.cuts(t or ""):
            parts.append(t[at:end])
            at = end
        assert "".join(parts) == (t or "")
        norm = [" ".join(p.lower().split()) for p in parts]
        again = []
        for x in norm:
            again.append(bool(x) and x in seen)
            seen.add(x)
        kept, k = [], 0
        while k < len(parts):
            end = k
            while end < len(parts) and again[end] == again[k]:
                end += 1
            if not again[k] or sum(len(x.split()) for x in norm[k:end]) < run_words:
                kept += parts[k:end]
            k = end
        out[d] = "".join(kept)
    return out


@pytest.mark.parametrize("run_words", [1, 30])
def test_against_brute_force_with_odd_rows(spark, run_words):
    hot = "The same passage stands in many documents, and it has more than thirty words in it, so that it is not a line " \
        "that recurs by chance but a copy of what was said elsewhere before."
    rows = [(1, None), (2, ""), (3, f"  \n{hot}\nOwn."), (4, f"First. {hot.upper()}  \n\nLast"), (5, "a\na\nb"), (6, "Own. Own. Own."), (7, hot + " " + hot)]
    rows += [(k, f"Text number {k}. {hot}\nEnd {k}!") for k in range(10, 200)]  # one unit in nearly all documents
    rows += [(300, "Very long. " + "x y z. " * 50_000), (301, "no blank" * 40_000)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, gone int, pos string")
    got = {r.doc_id: r.kept for r in ld.cleaned(df, run_words).collect()}
    assert got == brute(rows, run_words)


def test_offsets_repeated_ids_and_empty_table(spark):
    rows = [(1, PASSAGE), (2, f"Start here. {PASSAGE} End."), (2, f"Start here. {PASSAGE} End."), (2, "A"), (None, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r for r in ld.cleaned(df).collect()]
    for r in out:
        if r.kept == "A":
            continue
        text = dict(x for x in rows if x[1] != "A")[r.doc_id]
        gone = [tuple(s) for s in r.removed]
        assert r.kept == "".join(c for i, c in enumerate(text) if not any(s <= i < e for s, e in gone))
    assert sorted(r.kept for r in out if r.doc_id == 2) == ["A", "Start here. End.", "Start here. End."]  # equals rank alike
    assert [r.kept for r in out if r.doc_id is None] == [PASSAGE]
    assert ld.cleaned(df.limit(0)).count() == 0
