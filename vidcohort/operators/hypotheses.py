"""Search queries of subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidcohort.functions import text as t

MAX_QUERIES = 5


def subject_queries(subjects: DataFrame, mode: str = "title") -> DataFrame:
    """(subject_id, qpos, query) from subjects (subject_id, title, description).

    ``title``: the title itself is the one query; a subject without a title has none. ``hypotheses``:
    the queries that the title suggests. At most five are used.
    """
    if mode == "title":
        return subjects.where(t.text(F.col("title")) != "").select("subject_id", F.lit(0).alias("qpos"), F.col("title").alias("query"))
    found = t.hypotheses(F.col("title"), F.col("description"))
    return subjects.select("subject_id", F.posexplode(found).alias("qpos", "query")).where(F.col("qpos") < MAX_QUERIES)
