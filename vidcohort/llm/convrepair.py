"""Conversation structure repair by a grammar-compressed dynamic program.

1. ``damaged``: the rows with the faults of the contract put in (``sound`` leaves them as they are).
2. ``sequences``: rows without their texts, equal rows of a turn as one with a count, are ordered by a range partitioning on
   (conversation, turn), so that a conversation of any length is dealt to several tasks. Each task writes the letters
   (role class and fault) of its stretch of a conversation; a conversation's stretches are then joined, a byte a row.
3. ``grammar``: Re-Pair over the distinct sequences of all conversations: rounds of pair counts by Spark, the commonest pairs that
   cannot overlap become rules. The rules are bounded (``ROUNDS`` times ``RULES``), and only shorten the work: a
   sequence that they do not pack is repaired as well.
4. ``repairs``: one min-plus transfer matrix with audit ropes a rule, evaluated bottom-up; every distinct sequence is
   repaired once, for all conversations that have it.
5. ``repaired``: texts are shuffled once, sorted behind their conversation's audit and streamed through the digest; no
   conversation is held. (A digest of one text is sequential, so that a conversation's texts pass through one task,
   row by row.)

Rows of one turn are ordered by role, then by the digest of the text. Null texts, roles, ids and turns are one space
where they are read as text; a null conv_id is one conversation; null turns come first. Roles whose initial is not s, u
or a have to be changed or deleted. A conversation without rows after the damage has zeros and empty strings. Texts of any length,
repeated rows, extra columns of any name and empty tables are fine.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, drop_cut, read_table
from vidcohort.llm.grammar import CANON, FAULT_OF, FIRST_RULE, LETTERS, ROLE_OF, STEP, Grammar, choose, letter, pack, pairs

#: Fixed value: the characters that are blank.
BLANK = " \t\n\x0b\x0c\r"
ROUNDS, RULES = 12, 64
#: Letters of a stretch that are passed on together.
STRETCH = 1 << 16
ORDER = ["conv_id", "timed", "turn", "role", "sign"]


def _sign(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sound(conversations: DataFrame) -> DataFrame:
    """(conv_id as text, turn, role, text, n): the rows as they are, each once."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *spaced, F.lit(1).alias("n"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The same with faults by the checksum of conversation and turn; a dropped row stays with ``n`` = 0, a repeated one has 2."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    return sound(conversations).withColumn("fault", fault).select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("n"),
    )


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, letters, gaps) of every conversation of ``rows``, as made by ``sound`` or ``damaged``."""
    bare = F.rtrim("text", F.lit(BLANK))
    slim = cut(
        rows.select("conv_id", F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "n", _sign(F.col("text")).alias("sign"),
                    (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
        .groupBy(*ORDER).agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    )
    # texts of several turns of a conversation: few, so that a plain table of their first turns meets the rows
    firsts = cut(
        slim.where("n > 0").groupBy("conv_id", "role", "sign").agg(F.min(F.struct("timed", "turn")).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sign").alias("s"), "first")
    )
    again = F.coalesce(F.struct("timed", "turn") > F.col("first"), F.lit(False))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sign") == F.col("s"))
    ordered = (
        slim.join(firsts, same, "left").select(*ORDER, "n", "blank", "open", again.alias("again"))
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in ORDER]).sortWithinPartitions(*ORDER)
        .select("conv_id", "timed", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "open", "again", F.spark_partition_id().alias("part"))
    )

    names = ["timed", "turn", "initial", "n", "blank", "open", "again"]

    def run(batches):
        k, part = 0, None
        for b in batches:
            out, cid, own = [], None, []

            def close():
                nonlocal k
                if own:
                    out.append((k, cid, part, *stretch(own)))
                    k += 1

            for c, part, *row in zip(b["conv_id"], b["part"], *(b[x] for x in names)):
                if own and (c != cid or len(own) >= STRETCH):
                    close()
                    own = []
                cid = c
                own.append(row)
            close()
            yield pd.DataFrame(out, columns=["k", "conv_id", "part", "letters", "low", "high", "turns"])

    parts = ordered.mapInPandas(run, "k long, conv_id string, part int, letters string, low long, high long, turns long")

    @F.pandas_udf("letters string, gaps long")
    def whole(stretches: pd.Series) -> pd.DataFrame:
        out = []
        for xs in stretches:
            xs = sorted(xs, key=lambda x: (x["part"], x["k"]))
            timed = [x for x in xs if x["turns"]]
            turns = sum(x["turns"] for x in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            out.append(("".join(x["letters"] for x in xs), gaps))
        return pd.DataFrame(out, columns=["letters", "gaps"])

    grouped = parts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "k", "letters", "low", "high", "turns")).alias("x"))
    found = cut(grouped.select("conv_id", whole("x").alias("x")).select("conv_id", "x.*"))
    drop_cut(slim)
    drop_cut(firsts)
    return found


def stretch(rows: list) -> tuple:
    """Letters, and the least, the greatest and the number of turns, of consecutive rows of a conversation."""
    letters, turns = [], []
    for timed, turn, initial, n, blank, cut_off, again in rows:
        if not n:
            continue
        if blank:
            letters.append(letter(initial, "blank") * n)
        else:
            first = "duplicate" if again else "truncated" if cut_off else "fine"
            letters.append(letter(initial, first) + letter(initial, "duplicate") * (n - 1))
        if timed and (not turns or turns[-1] != turn):
            turns.append(turn)
    ends = (turns[0], turns[-1]) if turns else (0, 0)
    return ("".join(letters), *ends, len(turns))


def grammar(distinct: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair rules of the column ``canon``; at most ``ROUNDS`` times ``RULES``, whatever the input."""
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        known = list(rules)

        def run(batches, known=known):
            total = Counter()
            for b in batches:
                for x in b["canon"]:
                    total.update(pairs(pack(known, x)))
            yield pd.DataFrame(list(total.items()), columns=["pair", "n"])

        counts = distinct.mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        # characters are letters and rules, so that the pairs are no more than their square
        new = choose([(r["pair"], r["n"]) for r in counts.orderBy(F.desc("n"), "pair").limit(RULES * RULES).collect()], RULES)
        if not new:
            break
        rules += [(p, chr(FIRST_RULE + len(rules) + i)) for i, p in enumerate(new)]
    return rules


def repairs(found: DataFrame) -> DataFrame:
    """(canon, cost, audit) of the distinct sequences behind ``letters``."""
    canon = F.translate("letters", LETTERS, LETTERS.translate(CANON))
    distinct = cut(found.select(canon.alias("canon")).distinct())
    rules = grammar(distinct)

    def run(batches):
        own = Grammar(rules)
        for b in batches:
            done = [own.repair(x) for x in b["canon"]]
            yield pd.DataFrame({"canon": b["canon"], "cost": [c for c, _ in done], "audit": [a for _, a in done]})

    done = cut(distinct.mapInPandas(run, "canon string, cost long, audit string"))
    drop_cut(distinct)
    return found.withColumn("canon", canon).join(done, "canon")


def tally(letters: Column) -> list[Column]:
    """Counts of each fault, and of neighbours that may not follow each other, from a conversation's letters."""
    def times_of(chosen: list[str]) -> Column:
        return (F.length(letters) - F.length(F.translate(letters, "".join(chosen), ""))).cast("long")

    roles = F.translate(letters, LETTERS, "".join(ROLE_OF[x] for x in LETTERS))
    # every legal pair starts at a character of its own; u and a can be in two pairs, so each kind is counted alone
    fair = reduce(lambda a, b: a + b, [(F.length(roles) - F.length(F.replace(roles, F.lit(p), F.lit(p[0])))) for p in ("su", "ua", "au")])
    return [
        *[times_of([x for x in LETTERS if FAULT_OF[x] == f]).alias(f) for f in ("blank", "duplicate", "truncated")],
        (F.greatest(F.length(letters) - 1, F.lit(0)) - fair).cast("long").alias("illegal"),
    ]


class Mender:
    """The repaired text of one conversation, digested as its rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.digest = audit, 0, 0, 0, hashlib.sha256()

    def line(self, role: str, initial: str, text: str) -> None:
        self.state = STEP[initial][self.state]
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def due(self) -> tuple[str, str]:
        """The role that a changed or inserted message takes here."""
        return ("assistant", "a") if self.state == 2 else ("user", "u")

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(*self.due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, role[0], text)
        elif edit == "R":
            self.line(*self.due(), text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) for every row of ``audits`` (conv_id, audit)."""
    texts = rows.where("n > 0").select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", _sign(F.col("text")).alias("sign"), "text", "n"
    )
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    both = texts.unionByName(heads, allowMissingColumns=True)
    order = ["conv_id", "kind", *ORDER[1:]]

    def run(batches):
        cid, now = None, None
        for b in batches:
            out = []
            for c, kind, role, text, n in zip(b["conv_id"], b["kind"], b["role"], b["text"], b["n"]):
                if kind == 0:
                    if now is not None:
                        out.append((cid, now.end()))
                    cid, now = c, Mender(text)
                else:
                    for _ in range(int(n)):
                        now.row(role, text)
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(cid, now.end())], columns=["conv_id", "repaired_sha256"])

    dealt = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", F.coalesce("n", F.lit(0)).alias("n"))
    return dealt.mapInPandas(run, "conv_id string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``."""
    found = sequences(rows)
    done = cut(repairs(found).select("conv_id", "gaps", *tally(F.col("letters")), "cost", "audit"))
    digests = repaired(rows, done).select(F.col("conv_id").alias("c"), "repaired_sha256")
    return done.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def op13_convrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation, after the damage of the contract."""
    table = read_table(spark, sf_dir, "conversations")
    return repair(damaged(table)).withColumn("conv_id", F.col("conv_id").cast(table.schema["conv_id"].dataType))
