"""Conversation repair: matrices against every edit string, rules against none, the query against a row-by-row version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF
from vidcohort.llm import convrepair, grammar
from vidcohort.llm.grammar import CANON, FAULTS, Grammar, Rope, letter

ACCEPTED = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0d]")


def all_repairs(rows, most=2):
    """(cost, audit, roles) of every edit string with at most ``most`` insertions in a gap, that gives accepted roles."""
    gaps = [i for n in range(most + 1) for i in itertools.product("ua", repeat=n)]
    one = []
    for role, fault in rows:
        t = fault == "truncated"
        own = [("D", "", 3)]
        if fault not in ("blank", "duplicate"):
            own += [("K", role, 0 + t), ("R", "u", 2 + t), ("R", "a", 2 + t)]
        one.append(own)
    for edits in itertools.product(*one):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join("".join(i) + e[1] for i, e in zip(ins, [*edits, ("", "", 0)]))
            if ACCEPTED.fullmatch(roles):
                audit = "".join("I" * len(i) + e[0] for i, e in zip(ins, [*edits, ("", "", 0)]))
                yield sum(e[2] for e in edits) + 2 * sum(map(len, ins)), audit


def letters(rows):
    return "".join(letter(r, f) for r, f in rows).translate(CANON)


def test_against_every_edit_string():
    kinds = [(r, f) for r in "sua-" for f in FAULTS]
    own = Grammar([])
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert own.repair(letters(rows)) == min(all_repairs(rows)), rows
    rng = random.Random(3)
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(3)]
        assert own.repair(letters(rows)) == min(all_repairs(rows)), rows


def plain_repair(rows):
    """Row after row with whole strings: (cost, audit) for each state."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    now = {0: (0, "")}

    def insert(now):
        for _ in range(2):
            new = dict(now)
            for p, (c, x) in now.items():
                for r in "ua":
                    if p in step[r]:
                        new[step[r][p]] = min(new.get(step[r][p], (10**9, "")), (c + 2, x + "I"))
            now = new
        return now

    for role, fault in rows:
        new = {}
        for p, (c, x) in insert(now).items():
            ways = [(p, 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(step[r][p], k + (fault == "truncated"), e) for r, k, e in ((role, 0, "K"), ("u", 2, "R"), ("a", 2, "R")) if p in step.get(r, {})]
            for q, k, e in ways:
                new[q] = min(new.get(q, (10**9, "")), (c + k, x + e))
        now = new
    now = insert(now)
    return min(now[q] for q in (0, 3) if q in now)


def test_rules_change_nothing():
    rng = random.Random(5)
    kinds = [(r, f) for r in "sua-" for f in FAULTS]
    for n in (5, 40, 700):
        part = [rng.choice(kinds) for _ in range(n // 4 + 1)]
        rows = [x for _ in range(4) for x in part] + [rng.choice(kinds) for _ in range(n)]
        text, rules = letters(rows), []
        for _ in range(6):
            new = grammar.choose(list(grammar.pairs(grammar.pack(rules, text)).items()), 9)
            rules += [(p, chr(grammar.FIRST_RULE + len(rules) + i)) for i, p in enumerate(new)]
        assert not rules or len(grammar.pack(rules, text)) < len(text)
        assert Grammar(rules).repair(text) == Grammar([]).repair(text) == plain_repair(rows)


def test_ropes_compare_as_strings():
    rng = random.Random(1)
    made = [Rope(x) for x in ("", "K", "D", "I", "KD" * 9)]
    for _ in range(300):
        made.append(rng.choice(made) + rng.choice(made[-8:]))
        a, b = rng.choice(made), rng.choice(made)
        assert (a < b) == (str(a) < str(b)) and a.n == len(str(a))
        if made[-1].n > 5000:
            made = made[:40]


def plain(rows):
    """The contract row by row; rows are (conv_id, turn, role, text)."""
    by = defaultdict(list)
    space = lambda x: " " if x is None else x
    for cid, turn, role, text in rows:
        role, text, out = space(role), space(text), by[cid]
        f = zlib.crc32(f"{space(cid)}:{space(turn)}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    for cid, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = BLANK.findall(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit = plain_repair([(i if i in ("s", "u", "a") else "-", f) for i, f in zip(initials, faults)])
        lines, left, state = [], list(zip(own, faults)), ""
        for e in audit:
            due = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{due}:")
                state = due[0]
                continue
            (_, role, text), _ = left.pop(0)
            if e != "D":
                role = role if e == "K" else due
                lines.append(f"{role}:{text}")
                state = role[0]
        assert not left
        yield (
            cid, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, table):
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = convrepair.repair(convrepair.damaged(table)).withColumn("conv_id", F.col("conv_id").cast("long"))
    assert got.columns == COLUMNS
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]), key=key)
    assert rows == want
    return rows


def test_query_against_plain(spark):
    table = spark.read.parquet(SF.replace("0.001", "0.01") + "/conversations.parquet")
    got = {tuple(r) for r in convrepair.op13_convrepair(spark, SF.replace("0.001", "0.01")).select(*COLUMNS).collect()}
    assert got == set(check(spark, table)) and len(got) == table.select("conv_id").distinct().count()


def test_odd_rows(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", "", " \t\n", None, "Why?", "ж…", "x" * 200_000 + "!", "Yes. "]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(-3, 9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 9))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 40}.") for t in range(3000)]  # spans several tasks
    rows += [(2**60 + 1, 2**59, "user", "Yes."), (2**60 + 2, 2**59 + 1, "user", "Yes.")] + [(51, None, "user", "a.")] * 3
    dropped = next(i for i in range(100, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("sign", F.lit(1)).repartition(3)
    got = {r[0]: r for r in check(spark, table)}
    assert got[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert convrepair.repair(convrepair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
