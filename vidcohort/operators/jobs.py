"""States of acquisition jobs from what they report.

``current`` takes reports at their word; ``settled`` follows the legal transitions. A report is a map from the state before it to the
state after it; maps are composed in the order of ``seq``, and composing is associative, so a job's reports are cut into
chunks by ``seq``, each chunk becomes one map, and chunks are composed in two more steps. No group holds more than
``CHUNK`` numbers, however many reports one job has, and nothing depends on the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states in the order in which a job goes through them, and those that end it.
STATES = ["queued", "acquiring", "extracting", "analyzing", "complete", "partial", "failed"]
FINAL = ["complete", "partial", "failed"]
#: Which states may follow the place of a state in ``STATES``; place 0 stands for a job without any. The same state again is no change.
NEXT = [["queued"], ["acquiring", "failed"], ["extracting", "partial", "failed"], ["analyzing", "partial", "failed"], ["complete", "partial", "failed"], [], [], []]
CHUNK = 1024


def current(reports: DataFrame) -> DataFrame:
    """(job_id, state, reports, finished) from reports (job_id, seq, state): the first final state stays, before it the last report counts.

    Reports of unknown states are left out. Both states are taken in one grouping with map-side sums.
    """
    known = reports.where(F.col("state").isin(STATES))
    final = F.min(F.when(F.col("state").isin(FINAL), F.struct("seq", "state")))["state"]
    last = F.max(F.struct("seq", "state"))["state"]
    return known.groupBy("job_id").agg(F.coalesce(final, last).alias("state"), F.count("*").alias("reports"), final.isNotNull().alias("finished"))


def _place(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state).cast("int")


def _composed(maps: Column, then) -> Column:
    """One map from the ordered ``maps``: for each state before, the state after, how many reports were rejected, and the first of them."""
    none = F.lit(None).cast("struct<seq:bigint,state:string>")
    start = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("bigint").alias("rejected"), none.alias("first")) for i in range(len(NEXT))])
    return F.aggregate(maps, start, lambda done, x: F.transform(done, lambda d: then(d, x)))


def _report(d: Column, x: Column) -> Column:
    """The state ``d`` after the report ``x``."""
    legal = F.array(*[F.array(*[F.lit(STATES.index(s) + 1) for s in after]).cast("array<int>") for after in NEXT])
    fine = (d["to"] == x["place"]) | F.array_contains(F.element_at(legal, d["to"] + 1), x["place"])
    refused = F.struct(d["to"].alias("to"), (d["rejected"] + 1).alias("rejected"), F.coalesce(d["first"], F.struct(x["seq"].alias("seq"), x["state"].alias("state"))).alias("first"))
    return F.when(fine, F.struct(x["place"].alias("to"), d["rejected"].alias("rejected"), d["first"].alias("first"))).otherwise(refused)


def _chunk(d: Column, x: Column) -> Column:
    """The state ``d`` after the map of a chunk."""
    after = F.element_at(x["map"], d["to"] + 1)
    return F.struct(after["to"].alias("to"), (d["rejected"] + after["rejected"]).alias("rejected"), F.coalesce(d["first"], after["first"]).alias("first"))


def settled(reports: DataFrame) -> DataFrame:
    """(job_id, state, reports, rejected, first_rejected_seq, first_rejected_state) from reports (job_id, seq, state).

    Reports are ordered by seq, and by the order of states where a number has several; delivered again, they count once.
    Unknown states and reports without a number are left out. A report that may not follow the state before it is rejected and changes
    nothing; the state is null if all are.
    """
    rows = reports.withColumn("place", _place(F.col("state"))).where((F.col("place") > 0) & F.col("seq").isNotNull()).select("job_id", F.col("seq").cast("bigint").alias("seq"), "place", "state").distinct()
    one = F.struct("seq", "place", "state")
    level = rows.groupBy("job_id", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(_composed(F.array_sort(F.collect_list(one)), _report).alias("map"), F.count("*").alias("n"))
    for by in (["job_id", F.floor(F.col("chunk") / CHUNK).alias("chunk")], ["job_id"]):
        level = level.groupBy(*by).agg(_composed(F.array_sort(F.collect_list(F.struct("chunk", "map"))), _chunk).alias("map"), F.sum("n").alias("n"))
    end = F.col("map")[0]
    return level.select(
        "job_id", F.when(end["to"] > 0, F.element_at(F.array(*map(F.lit, STATES)), F.greatest(end["to"], F.lit(1)))).alias("state"), F.col("n").alias("reports"),
        end["rejected"].alias("rejected"), end["first"]["seq"].alias("first_rejected_seq"), end["first"]["state"].alias("first_rejected_state"),
    )
