"""DuckDB SQL of the queries on observations, jobs, rule tables, landed input and the feature store."""

from __future__ import annotations

from vidcohort.functions import rules as r
from vidcohort.operators import jobs, semantic
from vidcohort.plans import oracle as o
from vidcohort.sources import ingest

FIELD_NAME = "CASE o.ord " + " ".join(f"WHEN {i} THEN {o.q(n)}" for i, n in enumerate(semantic.FIELDS)) + " END"
#: Observations of all videos as words with weights.
OBSERVED = f"""convs AS (SELECT max(conv_id) + 1 AS m FROM conversations),
said AS (SELECT conv_id, string_split(arg_min(text, turn), ' ') AS w FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
obs AS (SELECT video_id, o.ord, {FIELD_NAME} AS field, array_to_string(list_filter(w, lambda x, i: (i - 1) % {len(semantic.FIELDS)} = o.ord), ' ') AS text
  FROM videos v CROSS JOIN convs JOIN said ON said.conv_id = v.k % m CROSS JOIN range({len(semantic.FIELDS)}) o(ord) WHERE said.conv_id % 7 <> 0),
obs_words AS (SELECT video_id, ord, field, text, unnest({o.word_list('text')}) AS word FROM obs),
weights AS (SELECT w.ord, word, any_value(n) // count(*) AS weight FROM obs_words w JOIN (SELECT ord, count(DISTINCT video_id) AS n FROM obs_words GROUP BY ord) USING (ord) GROUP BY w.ord, word)"""
#: Positions of the subjects against the medoids of their members.
POSITIONS = """mem AS (SELECT subject_id, 'user' AS grp, 0 AS pos, subject_id AS video_id FROM subjects UNION ALL SELECT subject_id, grp, pos, video_id FROM members),
mw AS (SELECT subject_id, grp, pos, ord, field, text, word, weight FROM mem JOIN obs_words USING (video_id) JOIN weights USING (ord, word)),
mt AS (SELECT subject_id, grp, pos, ord, field, text, CAST(sum(weight) AS BIGINT) AS total FROM mw GROUP BY subject_id, grp, pos, ord, field, text),
alike AS (
  SELECT c.subject_id, c.ord, c.grp, c.pos, c.grp2, CAST(c.shared AS DOUBLE) / (a.total + b.total - c.shared) AS alike
  FROM (SELECT x.subject_id, x.ord, x.grp, x.pos, y.grp AS grp2, y.pos AS pos2, CAST(sum(x.weight) AS BIGINT) AS shared FROM mw x JOIN mw y USING (subject_id, ord, word)
        WHERE (x.grp <> y.grp OR x.pos <> y.pos) AND (x.grp = y.grp OR y.grp = 'user') GROUP BY x.subject_id, x.ord, x.grp, x.pos, y.grp, y.pos) c
  JOIN mt a ON a.subject_id = c.subject_id AND a.ord = c.ord AND a.grp = c.grp AND a.pos = c.pos
  JOIN mt b ON b.subject_id = c.subject_id AND b.ord = c.ord AND b.grp = c.grp2 AND b.pos = c.pos2),
scored AS (SELECT subject_id, ord, grp, pos, sum(alike) FILTER (WHERE grp2 <> 'user') AS score, max(alike) FILTER (WHERE grp2 = 'user') AS to_user FROM alike GROUP BY subject_id, ord, grp, pos),
medoids AS (
  SELECT * FROM (SELECT subject_id, ord, grp, text, 1 - coalesce(to_user, 0) AS far, row_number() OVER (PARTITION BY subject_id, ord, grp ORDER BY coalesce(score, 0) DESC, pos) AS n
                 FROM mt LEFT JOIN scored USING (subject_id, ord, grp, pos) WHERE grp <> 'user') WHERE n = 1),
positions AS (
  SELECT *, CASE WHEN top_distance IS NULL OR lower_distance IS NULL THEN 'unknown' WHEN top_distance < lower_distance THEN 'closer_to_top' WHEN top_distance > lower_distance THEN 'closer_to_lower' ELSE 'equal' END AS position
  FROM (SELECT u.subject_id, u.ord, u.field, t.text AS top_medoid, l.text AS lower_medoid, t.far AS top_distance, l.far AS lower_distance FROM mt u
        LEFT JOIN medoids t ON t.subject_id = u.subject_id AND t.ord = u.ord AND t.grp = 'top' LEFT JOIN medoids l ON l.subject_id = u.subject_id AND l.ord = u.ord AND l.grp = 'lower' WHERE u.grp = 'user'))"""
KNOWN = "position <> 'unknown'"


def told(text: str, condition: str) -> str:
    return f"coalesce(string_agg({text}, '; ' ORDER BY ord) FILTER (WHERE {condition}), '')"


COMPARISON = f"""comparison AS (
  SELECT s.subject_id, CASE WHEN coalesce(n, 0) > 0 THEN 'ready' ELSE 'not_ready' END AS status, coalesce(d, '') AS semantic_differences, coalesce(p, '') AS user_position,
    CASE WHEN coalesce(n, 0) > 0 THEN '' ELSE {o.q(semantic.NOT_READY)} END AS warnings
  FROM subjects s LEFT JOIN (
    SELECT subject_id, count(*) FILTER (WHERE {KNOWN}) AS n, {told("field || ': top ''' || top_medoid || ''', lower ''' || lower_medoid || ''''", KNOWN + " AND top_medoid <> lower_medoid")} AS d,
      {told("field || ': ' || position", KNOWN)} AS p FROM positions GROUP BY subject_id) USING (subject_id))"""
LEGAL = "[" + ", ".join("[" + ", ".join(str(jobs.STATES.index(x) + 1) for x in after) + "]::BIGINT[]" for after in jobs.NEXT) + "]"
TRANSITIONS = f"""WITH placed AS (
  SELECT DISTINCT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 1 + event_id % 7 WHEN n < 8 THEN 1 + n // 2 ELSE 5 + user_id % 3 END AS place
  FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)),
folded AS (
  SELECT job_id, count(*) AS reports, list_reduce(list_prepend({{'at': 0::BIGINT, 'rejected': 0::BIGINT, 'seq': NULL::BIGINT, 'first': NULL::BIGINT}},
      list({{'at': place::BIGINT, 'rejected': 0::BIGINT, 'seq': seq::BIGINT, 'first': NULL::BIGINT}} ORDER BY seq, place)),
    lambda a, x: CASE WHEN a.at = x.at OR list_contains({LEGAL}[a.at + 1], x.at) THEN {{'at': x.at, 'rejected': a.rejected, 'seq': a.seq, 'first': a.first}}
      ELSE {{'at': a.at, 'rejected': a.rejected + 1, 'seq': coalesce(a.seq, x.seq), 'first': coalesce(a.first, x.at)}} END) AS f
  FROM placed GROUP BY job_id)
SELECT job_id, CASE WHEN f.at > 0 THEN {o.listed(jobs.STATES)}[f.at] END AS state, reports, f.rejected AS rejected, f.seq AS first_rejected_seq, {o.listed(jobs.STATES)}[f.first] AS first_rejected_state FROM folded"""
RESPONSES = """responses AS (SELECT k // 2 AS r, concat('f', CAST((k // 2) % 50 AS VARCHAR)) AS origin, k, row_number() OVER (PARTITION BY k // 2 ORDER BY k) - 1 AS item_pos FROM videos),
sorted AS (SELECT *, CASE WHEN r % 13 = 0 THEN 'not_json' WHEN r % 11 = 0 OR r % 7 = 0 THEN 'no_items' END AS whole, CASE WHEN k % 17 = 0 THEN 'no_id' WHEN k % 19 = 0 THEN 'no_snippet' END AS own FROM responses),
judged_items AS (SELECT DISTINCT origin, r, CASE WHEN whole IS NULL THEN item_pos END AS item_pos, coalesce(whole, own) AS reason, CASE WHEN whole IS NULL THEN k END AS k FROM sorted)"""
BODIES = """bodies AS (
  SELECT r, length(concat('{"items":[', string_agg(concat('{', CASE WHEN k % 17 <> 0 THEN concat('"id":"', video_id, '",') ELSE '' END,
    CASE WHEN k % 19 <> 0 THEN concat('"snippet":{"title":"', title, '","channelId":"', channel_id, '"},') ELSE '' END, '"statistics":{"viewCount":"', CAST(views AS VARCHAR), '"}}'), ','), ']}')) AS n
  FROM (SELECT *, k // 2 AS r FROM videos) GROUP BY r)"""
WINDOWS = """windows AS (SELECT video_id, 8 AS intro_seconds, k FROM videos UNION ALL SELECT video_id, 15, k FROM subjects),
acquired AS (SELECT video_id, intro_seconds, e.n AS n_frames FROM (SELECT w.*, w.k % n_users.n AS video_no FROM windows w, n_users) w
  LEFT JOIN (SELECT user_id, CAST(least(count(*), 15) AS BIGINT) AS n FROM events WHERE user_id % 10 <> 9 GROUP BY user_id) e ON e.user_id = w.video_no)"""
SOME_FAILED = """members AS (
  SELECT p.subject_id, p.grp, p.rank AS pos, b.*, CASE WHEN s.no % 10 = 9 THEN 'failed' END AS status
  FROM performers p JOIN bench b USING (video_id) JOIN (SELECT video_id, k % n AS no FROM videos, n_users) s USING (video_id) WHERE p.rank <= 3 AND s.no % 10 <> 8)"""


#: Bilinear samples of 8 x 8 gray levels on 90 rows of 160 cells.
GRID = """WITH px AS (SELECT CAST(vec_id // 10 AS VARCHAR) AS video_id, CAST(vec_id % 10 AS INTEGER) AS frame_no,
    list_transform(embedding, lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE))))) AS shade,
    list_transform(embedding, lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE))) / 2)) AS half FROM embeddings),
levels AS (SELECT video_id, frame_no, list_transform(range(1, 65), lambda i: round_even(0.114::DOUBLE * half[i] + 0.587::DOUBLE * shade[i] + 0.299::DOUBLE * shade[i], 0)) AS g FROM px),
ys AS (SELECT i, y, least(CAST(floor(y) AS BIGINT), 6) AS y0 FROM (SELECT i, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (i + 0.5::DOUBLE) * 8 / 90 - 0.5::DOUBLE)) AS y FROM range(90) r(i))),
xs AS (SELECT j, x, least(CAST(floor(x) AS BIGINT), 6) AS x0 FROM (SELECT j, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (j + 0.5::DOUBLE) * 8 / 160 - 0.5::DOUBLE)) AS x FROM range(160) r(j))),
cells AS (
  SELECT video_id, frame_no, i * 160 + j AS place,
    CAST(CAST((g[y0 * 8 + x0 + 1] * (1 - (y - y0)) + g[y0 * 8 + 8 + x0 + 1] * (y - y0)) * (1 - (x - x0))
      + (g[y0 * 8 + x0 + 2] * (1 - (y - y0)) + g[y0 * 8 + 8 + x0 + 2] * (y - y0)) * (x - x0) AS FLOAT) AS DOUBLE) AS v
  FROM levels CROSS JOIN ys CROSS JOIN xs)
SELECT video_id, frame_no, CAST(count(*) AS INTEGER) AS grid_px, CAST(sum(CAST(floor(v * 1000) AS BIGINT) * (place % 97 + 1)) AS BIGINT) AS weighted, max(v) AS highest FROM cells GROUP BY video_id, frame_no"""


def oracle_sql(feats: tuple[str, ...]) -> dict[str, str]:
    """``feats`` are the tables up to ``members``, which is the last one."""
    windows, some_failed = (o.VIDEOS, o.SUBJECTS, o.USERS, WINDOWS), (*feats[:-1], SOME_FAILED)
    landed, compared = (o.VIDEOS, RESPONSES), (*feats, OBSERVED, POSITIONS)
    fine = o.unpivot("member_long", "members", "subject_id, grp, pos").replace("FROM members", "FROM members WHERE status IS NULL")
    pulls = ", ".join(f"{o.first_rule('lower(title)', r.AUDIENCE_PULLS, r.DEFAULT_PULL, i)} AS {n}" for i, n in enumerate(("pull", "why")))
    counts = ", ".join(f"count(*) FILTER (WHERE reason = {o.q(x)}) AS {x}" for x in ingest.REASONS)
    return {
        "semantic_fields": o.sql(*compared, "SELECT subject_id, field, top_medoid, lower_medoid, round(top_distance, 9) AS top_distance, round(lower_distance, 9) AS lower_distance, position FROM positions"),
        "semantic_comparison": o.sql(*compared, COMPARISON, "SELECT * FROM comparison"),
        "job_transitions": TRANSITIONS,
        "frame_grid": GRID,
        "content_world_rules": o.sql(o.KEYWORD_VIDEOS, f"SELECT doc_id, {o.first_rule('lower(title)', r.CONTENT_WORLDS, r.DEFAULT_WORLD, 0)} AS world FROM kv"),
        "audience_pull_rules": o.sql(o.KEYWORD_VIDEOS, f"SELECT doc_id, {pulls} FROM kv"),
        "landed_quality": o.sql(*landed, f"SELECT origin, count(*) FILTER (WHERE reason IS NULL) AS usable, {counts} FROM judged_items GROUP BY origin"),
        "landed_rejected": o.sql(*landed, BODIES, """SELECT origin, reason, CAST(item_pos AS INTEGER) AS item_pos, count(*) AS n,
            CAST(max(CASE WHEN reason = 'not_json' THEN 25 WHEN reason = 'no_items' AND r % 11 = 0 THEN 12 WHEN reason = 'no_items' THEN 17 ELSE b.n END) AS INTEGER) AS longest
          FROM judged_items JOIN bodies b USING (r) WHERE reason IS NOT NULL GROUP BY origin, reason, item_pos"""),
        "landed_videos": o.sql(*landed, "SELECT video_id, title, channel_id, views FROM judged_items JOIN videos USING (k) WHERE reason IS NULL"),
        "cohort_states": o.sql(*some_failed, "SELECT subject_id, grp, CAST(pos AS INTEGER) AS pos, video_id, status FROM members"),
        "dominant_acquired": o.sql(*some_failed, fine, o.DOMINANT, "SELECT * FROM dominant"),
        "evidence_missing": o.sql(*windows, "SELECT video_id, intro_seconds FROM acquired WHERE n_frames IS NULL"),
        "evidence_reuse": o.sql(*windows, "SELECT video_id, intro_seconds, n_frames FROM acquired WHERE n_frames IS NOT NULL"),
    }
