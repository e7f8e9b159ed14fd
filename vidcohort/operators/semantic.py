"""Comparison of observations: what is typical of the top and of the lower group, and which of them a subject is nearer to.

Texts are compared field by field as weighted word sets: a word weighs as many times as it is rarer than the commonest possible,
(observations of the field) / (observations with the word), in whole numbers. The similarity of two texts is the weight of
their common words over the weight of all their words. Of each group the medoid is taken, the text that is most similar to
the others of its group; the subject's distance to both medoids then tells its position in that field.

A subject has at most a few members a group, so that every comparison is a join by (subject, field) between few rows, each with its
weighted words; the weights are counted over all observations with map-side sums. No text meets a text of another subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.functions import text as t
from vidcohort.sources.stored import cut

FIELDS = ["opening_type", "attention_focus", "first_meaningful_action", "movement_progression", "emotional_impression", "visual_focus"]
# What is told of observations that cannot be compared.
NOT_READY = "Semantic comparison is not connected yet."
READY = ["subject_id", "status", "semantic_differences", "user_position", "warnings"]


def field_texts(observations: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, ord, field, text) of the observations that succeeded."""
    fields = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("field"), F.col(n).alias("text")) for i, n in enumerate(FIELDS)])
    return observations.where("status = 'success'").select(key, F.explode(fields).alias("f")).select(key, "f.*")


def field_words(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, word) of texts (keys, text); a text without words has no row."""
    return texts.select(*keys, F.explode(t.word_set(F.col("text"))).alias("word"))


def weights(texts: DataFrame, key: str = "video_id") -> DataFrame:
    """(ord, word, weight) over all observations' texts (key, ord, text); equal texts of a field are taken apart once."""
    equal = texts.groupBy("ord", "text").agg(F.count("*").alias("n"))
    per_word = field_words(equal, "ord", "n").groupBy("ord", "word").agg(F.sum("n").alias("df"))
    some = texts.where(F.lower(t.text(F.col("text"))).rlike("[a-z0-9]"))  # has a word
    per_field = some.groupBy("ord").agg(F.count_distinct(key).alias("n"))  # a row a field
    return per_word.join(per_field, "ord").select("ord", "word", F.floor(F.col("n") / F.col("df")).alias("weight"))


def field_positions(members: DataFrame, observations: DataFrame) -> DataFrame:
    """(subject_id, ord, field, top_medoid, lower_medoid, top_distance, lower_distance, position).

    ``members`` has subject_id, grp (user, top or lower), pos and video_id. Only fields in which the subject has words; a medoid and its
    distance are null if nobody in the group has. Ties go to the first member. Only members' texts are kept as words, in one row a text.
    """
    own = ["subject_id", "ord", "grp", "pos"]
    # a row becomes hundreds of words: dealt to all tasks, however few bytes it has
    tasks = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = cut(field_texts(observations.repartition(tasks, "video_id")))
    named = cut(members.repartition(tasks, "video_id").join(every.hint("merge"), "video_id").select(*own, "field", "text"))
    weighed = field_words(named, *own).join(cut(weights(every)), ["ord", "word"]).repartition(tasks, "subject_id", "ord")
    sums = weighed.groupBy(*own).agg(F.sum("weight").alias("total"), F.collect_list(F.concat_ws(" ", F.col("weight").cast("string"), "word")).alias("words"))
    texts = cut(sums.join(named.hint("merge"), own))  # each word behind its weight, as one string: texts meet by hashing, not word by word
    other = texts.select("subject_id", "ord", F.col("grp").alias("grp2"), F.col("pos").alias("pos2"), F.col("total").alias("total2"), F.col("words").alias("words2"))
    different = (F.col("grp") != F.col("grp2")) | (F.col("pos") != F.col("pos2"))
    wanted = (F.col("grp") == F.col("grp2")) | (F.col("grp2") == "user")
    met = texts.join(other.hint("merge"), ["subject_id", "ord"]).where(different & wanted)
    met = met.withColumn("common", F.explode(F.array(F.array_intersect("words", "words2")))).where(F.size("common") > 0)
    alike = met.select(*own, "grp2", "total", "total2", F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + F.substring_index(x, " ", 1).cast("bigint")).alias("both"))
    alike = alike.withColumn("alike", F.col("both") / (F.col("total") + F.col("total2") - F.col("both")))
    scores = alike.groupBy(*own).agg(
        F.sum(F.when(F.col("grp2") != "user", F.col("alike"))).alias("score"), F.max(F.when(F.col("grp2") == "user", F.col("alike"))).alias("to_user")
    )
    best = Window.partitionBy("subject_id", "ord", "grp").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")
    medoids = texts.drop("words").where("grp <> 'user'").join(scores.hint("merge"), own, "left").withColumn("place", F.row_number().over(best)).where("place = 1")
    side = lambda g, c: F.max(F.when(F.col("grp") == g, c))
    far = 1 - F.coalesce("to_user", F.lit(0.0))
    sides = medoids.groupBy("subject_id", "ord").agg(
        side("top", F.col("text")).alias("top_medoid"), side("lower", F.col("text")).alias("lower_medoid"), side("top", far).alias("top_distance"), side("lower", far).alias("lower_distance")
    )
    near = F.when(F.col("top_distance").isNull() | F.col("lower_distance").isNull(), "unknown").when(F.col("top_distance") < F.col("lower_distance"), "closer_to_top")
    near = near.when(F.col("top_distance") > F.col("lower_distance"), "closer_to_lower").otherwise("equal")
    users = texts.where("grp = 'user'").select("subject_id", "ord", "field")
    return users.join(sides.hint("merge"), ["subject_id", "ord"], "left").withColumn("position", near)


def comparison(subjects: DataFrame, positions: DataFrame) -> DataFrame:
    """(subject_id, status, semantic_differences, user_position, warnings): a row a subject.

    Ready if some field could be compared with both groups. A difference is a field whose groups have other typical texts.
    """
    known = F.col("position") != "unknown"
    told = lambda c: F.struct("ord", c.alias("x"))
    differs = F.when(known & (F.col("top_medoid") != F.col("lower_medoid")), told(F.concat("field", F.lit(": top '"), "top_medoid", F.lit("', lower '"), "lower_medoid", F.lit("'"))))
    placed = F.when(known, told(F.concat("field", F.lit(": "), "position")))
    lists = [F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"]).alias(n) for c, n in ((differs, "semantic_differences"), (placed, "user_position"))]
    rows = subjects.select("subject_id").join(positions.groupBy("subject_id").agg(*lists).hint("merge"), "subject_id", "left")
    ready: Column = F.size(F.coalesce("user_position", F.array().cast("array<string>"))) > 0
    none = F.array().cast("array<string>")
    return rows.select(
        "subject_id", F.when(ready, "ready").otherwise("not_ready").alias("status"), F.coalesce("semantic_differences", none).alias("semantic_differences"),
        F.coalesce("user_position", none).alias("user_position"), F.when(ready, none).otherwise(F.array(F.lit(NOT_READY))).alias("warnings"),
    )
