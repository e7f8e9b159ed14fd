import random

import numpy as np

from vidcohort.llm import decontam as dc


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert dc.lcs(a, b) == brute_lcs(a, b)


def table(rows, kind, spark):
    return spark.createDataFrame(rows, kind)


def test_finds_verbatim_and_paraphrased_items_and_nothing_else(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    common = ["the", "of", "and", "to"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [prose(rng.randint(14, 60)) for _ in range(30)]
    docs, want = [], set()
    for d in range(300):
        own = prose(rng.randint(0, 300))
        if d % 5 == 0:
            k = d // 5 % 30
            item = list(items[k])
            if d % 10 == 0:  # a paraphrase: some words swapped for others
                for at in rng.sample(range(len(item)), len(item) // 6):
                    item[at] = rng.choice(vocab)
            at = rng.randint(0, len(own))
            own[at:at] = item
            want.add((d, k))
        docs.append((d, " ".join(own).replace("the", "The"), "x"))
    benchmark = table([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, ""), (97, "one two")], "item_id long, text string", spark)
    df = table([*docs, (400, None, "x"), (401, "", "x")], "doc_id long, text string, cosine string", spark)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark, df, benchmark).collect()}
    assert got == want
    kept = dc.keep_clean(spark, df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {d for d, _ in want} | {400, 401}


def test_empty_tables(spark):
    docs = table([(1, "some text here")], "doc_id long, text string", spark)
    bench = table([(1, "a b c d e f g")], "item_id long, text string", spark)
    assert dc.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert dc.contaminated(spark, docs.limit(0), bench).count() == 0
    assert dc.keep_clean(spark, docs, bench.limit(0)).count() == 1


def test_query_against_brute_force(spark):
    """Every document whose words contain an item's words one after the other is found; the rest is clean."""
    sf = "/root/testdata/sf0.01"
    norm = lambda t: " " + " ".join(map(str, dc.words([t or ""])[0].tolist())) + " "
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items.items() if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in dc.op4_decontam(spark, sf).collect()}
    assert want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def test_passages_cover_all_words():
    owner = np.repeat([0, 1, 3], [5, 100, 24])
    first, last = dc.passages(owner)
    assert all(owner[f] == owner[la - 1] for f, la in zip(first, last))
    assert set(np.concatenate([np.arange(f, la) for f, la in zip(first, last)])) == set(range(129))


def test_finds_short_items_in_long_documents(spark):
    """Verbatim items of five to twelve words, among benchmark words and among others, and nothing else."""
    rng = random.Random(11)
    make = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(5, 9)))
    known, other = [make() for _ in range(800)], [make() for _ in range(3000)]
    items = [rng.sample(known, n) for n in range(5, 13) for _ in range(4)] + [rng.sample(known, 40) for _ in range(20)]
    docs, want = [], set()
    for d in range(160):
        own = [rng.choice(other if d % 2 else known) for _ in range(rng.randint(100, 300))]
        if d < 128:
            k = d // 4
            at = rng.randint(0, len(own))
            own[at:at] = items[k]
            want.add((d, k))
        docs.append((d, " ".join(own)))
    benchmark = table([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string", spark)
    df = table(docs, "doc_id long, text string", spark)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(spark, df, benchmark).collect()} == want


def test_recall_of_paraphrases_in_given_documents(spark):
    """Given items with a tenth or a fifth of their words swapped, put into given documents, against all pairs by brute LCS."""
    sf, rng = "/root/testdata/sf0.001", random.Random(21)
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = [(r.doc_id, (r.text or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pool = [w for _, t in docs for w in t]
    rows, wanted = [], set()
    for n, (d, own) in enumerate(docs):
        k = rng.choice(list(items))
        item = list(items[k])
        for at in rng.sample(range(len(item)), len(item) * (n % 3) // 10):
            item[at] = rng.choice(pool)
        at = rng.randint(0, len(own))
        rows.append((d, " ".join(own[:at] + item + own[at:])))
        wanted.add((d, k))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(spark, table(rows, "doc_id long, text string", spark), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(found & wanted) >= 0.97 * len(wanted)


def test_ids_that_are_null_or_large_and_long_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron"
    long = "filler words of no item " * 60_000
    rows = [(None, f"x {item} y"), (2**60 + 1, f"x {item} y"), (2**60 + 1, f"x {item} y"), (3, long + item + long), (4, long)]
    bench = table([(7, item), (7, item)], "item_id long, text string", spark)
    got = sorted(((r.doc_id or 0, r.item_id) for r in dc.contaminated(spark, table(rows, "doc_id long, text string", spark), bench).collect()))
    assert set(got) == {(0, 7), (3, 7), (2**60 + 1, 7)}
