"""DuckDB SQL of the registered queries, composed of common table expressions over the given tables."""

from __future__ import annotations

from vidcohort.functions import rules as r
from vidcohort.functions import text as t
from vidcohort.operators import cohort, contrast, features, jobs
from vidcohort.plans import report
from vidcohort.sources import ingest


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def word_list(c: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(c)}, ' '), lambda x: x <> ''))"


def query_text(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def first_rule(c: str, rules, default, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(c, x[-1])} THEN {q(x[k])}" for x in rules) + f" ELSE {q(default[k])} END"


def filled(template: str, **columns: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    out = [columns[p] if i % 2 else q(p).replace("\n", "' || chr(10) || '") for i, p in enumerate(parts) if i % 2 or p]
    return " || ".join(out)


VIDEOS = """videos AS (
  SELECT p_partkey AS k, concat('v', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS video_id,
         concat(p_name, ' | ', p_type, ' - m', substr(p_brand, 7)) AS title, p_brand AS channel_id,
         CAST(sum(l_quantity) AS BIGINT) * (p_partkey % 11) AS views,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS likes, count(DISTINCT l_orderkey) AS comments
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type, p_brand)"""
CHANNELS = """channels AS (
  SELECT channel_id, CAST(floor(avg(views) * (2 + CAST(substr(channel_id, 7) AS INT) % 12)) AS BIGINT) AS subscribers
  FROM videos GROUP BY channel_id)"""
SUBJECTS = "subjects AS (SELECT *, video_id AS subject_id FROM videos WHERE k % 20 = 0)"
TITLE_QUERIES = "queries AS (SELECT subject_id, 0 AS qpos, title AS query FROM subjects WHERE title <> '')"
CLEAN_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(title, 'http\S+', ' ', 'g'), '[^a-zA-Z0-9\s|:\-'']', ' ', 'g'), '\s+', ' ', 'g'))"
STRONG = f"array_to_string(list_filter(string_split(x, ' '), lambda w: w <> '' AND NOT list_contains({listed(t.WEAK_WORDS)}, lower(w))), ' ')"
HYPOTHESES = f"""hyp_parts AS (
  SELECT subject_id, unnest(p) AS x, unnest(range(len(p))) AS part
  FROM (SELECT subject_id, list_transform(list_append(regexp_split_to_array({CLEAN_TITLE}, '[|:\\-]'), {CLEAN_TITLE}), lambda y: {query_text('y')}) AS p FROM subjects)),
hyp_all AS (
  SELECT subject_id, 2 * part AS ord, {STRONG} AS query FROM hyp_parts UNION ALL SELECT subject_id, 2 * part + 1, x FROM hyp_parts),
hyp_first AS (
  SELECT subject_id, ord, query, row_number() OVER (PARTITION BY subject_id, lower(query) ORDER BY ord) AS n
  FROM hyp_all WHERE len(list_filter(string_split(query, ' '), lambda w: w <> '')) >= 2),
hyp AS (
  SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY ord) - 1 AS INTEGER) AS qpos, query FROM hyp_first WHERE n = 1),
queries AS (SELECT * FROM hyp WHERE qpos < 5)"""
SEARCH = f"""vtok AS (SELECT video_id, unnest({word_list('title')}) AS token FROM videos),
qtok AS (SELECT subject_id, qpos, unnest({word_list('query')}) AS token FROM queries),
pairs AS (SELECT subject_id, qpos, video_id, count(*) AS overlap FROM qtok JOIN vtok USING (token) GROUP BY subject_id, qpos, video_id),
candidates AS (
  SELECT subject_id, qpos, CAST(pos AS INTEGER) AS pos, video_id, overlap, views FROM (
    SELECT o.*, views, row_number() OVER (PARTITION BY subject_id, qpos ORDER BY overlap DESC, views DESC, video_id) AS pos
    FROM pairs o JOIN videos USING (video_id))
  WHERE pos <= 15 AND video_id <> subject_id AND views > 0),
scores AS (
  SELECT subject_id, qpos, query, CAST(coalesce(sum(overlap), 0) AS BIGINT) AS score
  FROM queries LEFT JOIN candidates USING (subject_id, qpos) GROUP BY subject_id, qpos, query),
best AS (
  SELECT subject_id, qpos, query, score FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, qpos) AS n FROM scores) WHERE n = 1)"""
COHORT = f"""of_best AS (SELECT c.* FROM candidates c JOIN best USING (subject_id, qpos)),
listed AS (
  SELECT subject_id, list({{'pos': pos, 'video_id': video_id, 'overlap': overlap, 'views': views, 'short': substr({norm('title')}, 1, 80), 'channel': {norm('channel_id')}, 'channel_id': channel_id}} ORDER BY pos) AS l
  FROM (SELECT o.subject_id, o.pos, o.video_id, o.overlap, v.views, v.title, v.channel_id FROM of_best o JOIN videos v USING (video_id)) GROUP BY subject_id),
folded AS (
  SELECT subject_id, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda kept, one:
    CASE WHEN len(list_filter(kept, lambda p: p.video_id = one[1].video_id OR p.short = one[1].short)) > 0
           OR len(list_filter(kept, lambda p: p.channel = one[1].channel)) >= 2 THEN kept ELSE list_concat(kept, one) END)) AS v
  FROM listed),
cleaned AS (
  SELECT subject_id, v.pos AS pos, v.video_id AS video_id, v.overlap AS overlap, v.views AS views, v.channel_id AS channel_id,
         row_number() OVER (PARTITION BY subject_id ORDER BY v.overlap DESC, v.views DESC, v.pos) AS rank
  FROM folded),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY views DESC, overlap DESC, pos) AS place FROM cleaned),
tops AS (SELECT * FROM placed WHERE place <= 5),
rest AS (SELECT * FROM placed WHERE place > 5),
strict AS (
  SELECT r.* FROM rest r JOIN (SELECT subject_id, min(views) * 0.5::DOUBLE AS ceiling FROM tops GROUP BY subject_id) c USING (subject_id)
  WHERE r.views <= c.ceiling AND NOT EXISTS (SELECT 1 FROM tops x WHERE x.subject_id = r.subject_id AND x.channel_id = r.channel_id)),
sizes AS (
  SELECT subject_id, (SELECT count(*) FROM strict x WHERE x.subject_id = p.subject_id) AS n_strict, (SELECT count(*) FROM rest x WHERE x.subject_id = p.subject_id) AS n_rest
  FROM (SELECT DISTINCT subject_id FROM placed) p),
pool AS (
  SELECT x.* FROM strict x JOIN sizes USING (subject_id) WHERE n_strict >= 3
  UNION ALL SELECT x.* FROM rest x JOIN sizes USING (subject_id) WHERE n_strict < 3 AND n_rest >= 3),
lowers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY views, place) AS low FROM pool) WHERE low <= 5),
reasons AS (SELECT subject_id, CASE WHEN n_strict >= 3 THEN {q(cohort.STRICT)} WHEN n_rest >= 3 THEN {q(cohort.FALLBACK)} ELSE {q(cohort.TOO_FEW)} END AS reason FROM sizes),
performers AS (
  SELECT subject_id, 'top' AS grp, place AS rank, video_id, views, overlap FROM tops
  UNION ALL SELECT subject_id, 'lower', low, video_id, views, overlap FROM lowers)"""
FRAMES = """frames AS (
  SELECT * FROM (
    SELECT user_id AS video_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no,
      value * CAST(0.5 AS DOUBLE) + (user_id % 7) * 35 AS luma, value * (CAST(0.04 AS DOUBLE) + (user_id % 5) * CAST(0.08 AS DOUBLE)) AS diff,
      CAST((user_id * 31 + event_id % 40) % 180 AS DOUBLE) AS mean_hue, event_id % 10 AS valid_px,
      CAST((user_id * 7 + event_id * 3) % 20 AS DOUBLE) / 100 AS edge_density, CASE WHEN user_id % 3 = 0 THEN event_id % 2 ELSE 0 END AS face_count
    FROM events) WHERE frame_no <= 15)"""
D = lambda x: f"CAST({x} AS DOUBLE)"
COLOR = "CASE WHEN valid_px <= 0 THEN 'neutral' WHEN mean_hue < 25 OR mean_hue > 150 THEN 'warm' WHEN mean_hue BETWEEN 80 AND 140 THEN 'cool' ELSE 'neutral' END"
OVERLAY = f"CASE WHEN edge_density > {D(0.13)} THEN 'present' WHEN edge_density < {D(0.03)} THEN 'absent' ELSE 'unknown' END"
HUMAN = "CASE WHEN face_count > 0 THEN 'present' ELSE 'unknown' END"


def intro(name: str, frames: int) -> str:
    """The features of intros of so many frames as table ``name``."""
    major = " UNION ALL ".join(f"SELECT video_no, frame_no, '{n}' AS f, {c} AS v FROM frames WHERE frame_no <= {frames}" for n, c in (("color", COLOR), ("text", OVERLAY), ("human", HUMAN)))
    return f"""{name}_votes AS (
  SELECT video_no, f, v, row_number() OVER (PARTITION BY video_no, f ORDER BY count(*) DESC, min(frame_no)) AS n FROM ({major}) WHERE v <> 'unknown' GROUP BY video_no, f, v),
{name}_m AS (
  SELECT video_no, max(CASE WHEN f = 'color' THEN v END) AS color, max(CASE WHEN f = 'text' THEN v END) AS text_overlay, max(CASE WHEN f = 'human' THEN v END) AS human_presence
  FROM {name}_votes WHERE n = 1 GROUP BY video_no),
{name}_n AS (
  SELECT video_no, count(*) AS frames_analyzed, avg(luma) AS luma, coalesce(avg(CASE WHEN frame_no > 1 THEN diff END), 0) AS diff,
         count(*) FILTER (WHERE frame_no > 1 AND diff >= 25) AS changes FROM frames WHERE frame_no <= {frames} GROUP BY video_no),
{name}_c AS (
  SELECT video_no, frames_analyzed, changes, CASE WHEN luma < 75 THEN 'dark' WHEN luma > 170 THEN 'bright' ELSE 'medium' END AS dominant_lighting,
    coalesce(color, 'unknown') AS dominant_color_feel, coalesce(text_overlay, 'unknown') AS text_overlay, coalesce(human_presence, 'unknown') AS human_presence,
    CASE WHEN diff < 8 THEN 'low' WHEN diff < 22 THEN 'medium' ELSE 'high' END AS motion_level,
    CASE WHEN frames_analyzed <= 1 THEN 'unknown' WHEN changes / {D('frames_analyzed - 1')} < {D(0.2)} THEN 'slow' WHEN changes / {D('frames_analyzed - 1')} < {D(0.45)} THEN 'medium' ELSE 'fast' END AS pacing_level
  FROM {name}_n LEFT JOIN {name}_m USING (video_no)),
{name} AS (
  SELECT video_no, frames_analyzed, changes AS scene_changes, changes AS scene_change_count, dominant_lighting, dominant_color_feel, motion_level, pacing_level,
    CASE WHEN e <= 1 THEN 'low' WHEN e <= 3 THEN 'medium' ELSE 'high' END AS visual_energy, human_presence, text_overlay,
    CASE WHEN human_presence = 'present' AND text_overlay = 'present' THEN 'reaction' WHEN human_presence = 'present' AND motion_level IN ('low', 'medium') THEN 'commentary'
         WHEN motion_level = 'high' AND pacing_level = 'fast' THEN 'montage' WHEN motion_level IN ('medium', 'high') AND human_presence = 'unknown' THEN 'movie_scene' ELSE 'unknown' END AS scene_type
  FROM (SELECT *, CASE motion_level WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END + CASE pacing_level WHEN 'medium' THEN 1 WHEN 'fast' THEN 2 ELSE 0 END AS e FROM {name}_c))"""


USERS = "n_users AS (SELECT max(user_id) + 1 AS n FROM events)"
CLASS_COLUMNS = ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in features.CLASSES)


def summary(name: str, source: str, intro_name: str, ids: str) -> str:
    return f"""{name} AS (
  SELECT {ids}, coalesce(frames_analyzed, 0) AS frames_analyzed, coalesce(scene_changes, 0) AS scene_changes, coalesce(scene_change_count, 0) AS scene_change_count, {CLASS_COLUMNS}
  FROM (SELECT s.*, s.k % n AS video_no FROM {source} s, n_users) LEFT JOIN {intro_name} USING (video_no))"""


MEMBERS = "members AS (SELECT p.subject_id, p.grp, p.rank AS pos, b.* FROM performers p JOIN bench b USING (video_id) WHERE p.rank <= 3)"


def unpivot(name: str, source: str, ids: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {ids}, {i} AS feature_ord, '{f}' AS feature, lower(trim(CAST({f} AS VARCHAR))) AS value FROM {source}" for i, (f, _) in enumerate(features.FEATURES))
    return f"{name} AS ({rows})"


DOMINANT = """dom_counts AS (SELECT subject_id, grp, feature, value, count(*) AS n, min(pos) AS first FROM member_long WHERE value <> 'unknown' GROUP BY subject_id, grp, feature, value),
dom_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, grp, feature ORDER BY n DESC, first) AS place,
         CAST(sum(n) OVER (PARTITION BY subject_id, grp, feature) AS BIGINT) AS total, count(*) OVER (PARTITION BY subject_id, grp, feature, n) AS same FROM dom_counts),
dominant AS (SELECT subject_id, grp, feature, value, n AS count, total, n >= 2 AND same = 1 AS is_dominant FROM dom_ranked WHERE place = 1)"""


def evidence(group: str, p: str) -> str:
    return f"""CASE WHEN {p}t = 0 THEN '{group}: no classified benchmark intros available.'
    WHEN NOT {p}d THEN '{group}: no clear dominant value across ' || {p}t || ' classified intro(s).'
    ELSE '{group}: ''' || {p}v || ''' appeared in ' || {p}c || ' of ' || {p}t || ' classified intro(s).' END"""


LABEL = "CASE feature " + " ".join(f"WHEN {q(f)} THEN {q(name)}" for f, name in features.FEATURES) + " END"
CONTRAST = f"""sides AS (
  SELECT u.subject_id, u.feature_ord, u.feature, {LABEL.replace('CASE feature', 'CASE u.feature')} AS label, u.value AS uv, u.feature IN ('dominant_lighting', 'dominant_color_feel') AS descriptive,
    coalesce(a.value, 'unknown') AS tv, coalesce(a.count, 0) AS tc, coalesce(a.total, 0) AS tt, coalesce(a.is_dominant, false) AS td,
    coalesce(b.value, 'unknown') AS lv, coalesce(b.count, 0) AS lc, coalesce(b.total, 0) AS lt, coalesce(b.is_dominant, false) AS ld
  FROM user_long u LEFT JOIN dominant a ON a.subject_id = u.subject_id AND a.feature = u.feature AND a.grp = 'top'
  LEFT JOIN dominant b ON b.subject_id = u.subject_id AND b.feature = u.feature AND b.grp = 'lower'),
judged AS (
  SELECT *, CASE WHEN uv = 'unknown' THEN 'insufficient_evidence'
    WHEN descriptive THEN CASE WHEN NOT td THEN 'insufficient_evidence' WHEN uv = tv THEN 'observed_alignment' ELSE 'observed_difference' END
    WHEN NOT td OR NOT ld THEN 'insufficient_evidence' WHEN tv = lv THEN 'non_discriminative' WHEN uv = tv THEN 'aligned_with_top' WHEN uv = lv THEN 'risk_signal'
    ELSE 'missing_winning_feature' END AS status FROM sides),
contrast AS (
  SELECT subject_id, feature_ord, feature, label, uv AS user_value, tv AS top_dominant_value, tc AS top_evidence_count, tt AS top_evidence_total, {evidence('Top benchmarks', 't')} AS top_evidence,
    lv AS lower_dominant_value, lc AS lower_evidence_count, lt AS lower_evidence_total, {evidence('Lower benchmarks', 'l')} AS lower_evidence, status,
    label || ': ' || CASE WHEN uv = 'unknown' THEN 'the user value is unknown, so no position is assigned.'
      WHEN status = 'observed_alignment' THEN 'the observed user value ''' || uv || ''' matches the dominant top benchmark value. This observation does not affect the verdict.'
      WHEN status = 'observed_difference' THEN 'the observed user value ''' || uv || ''' differs from the dominant top benchmark value ''' || tv || '''. This observation does not affect signals, the verdict, or recommendations.'
      WHEN NOT td THEN 'top performers did not show a clear dominant value.'
      WHEN NOT descriptive AND NOT ld THEN 'lower performers did not show a clear dominant value, so this feature cannot position the user.'
      WHEN status = 'non_discriminative' THEN '''' || tv || ''' dominates both benchmark groups, so this feature does not distinguish them.'
      WHEN status = 'aligned_with_top' THEN 'user value ''' || uv || ''' matches the dominant top benchmark value and differs from the lower benchmark value ''' || lv || '''.'
      WHEN status = 'risk_signal' THEN 'user value ''' || uv || ''' matches the dominant lower benchmark value and differs from the top benchmark value ''' || tv || '''.'
      ELSE 'user value ''' || uv || ''' differs from the dominant top benchmark value ''' || tv || '''.' END AS explanation
  FROM judged)"""
CONFIDENCE = f"""levels AS (
  SELECT subject_id, top_count, lower_count, usable, CASE WHEN top_count >= 3 AND lower_count >= 3 AND usable >= 2 THEN 'moderate' WHEN top_count >= 2 AND lower_count >= 2 AND usable >= 1 THEN 'limited' ELSE 'low' END AS confidence,
    aligned, missing, risks
  FROM (SELECT s.subject_id, (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'top') AS top_count, (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'lower') AS lower_count,
    count(*) FILTER (WHERE status IN ({', '.join(q(s) for s in contrast.SIGNALS)})) AS usable, count(*) FILTER (WHERE status = 'aligned_with_top') AS aligned,
    count(*) FILTER (WHERE status = 'missing_winning_feature') AS missing, count(*) FILTER (WHERE status = 'risk_signal') AS risks
    FROM subjects s LEFT JOIN contrast c USING (subject_id) GROUP BY s.subject_id))"""
KEYWORD_VIDEOS = f"kv AS (SELECT doc_id, concat(coalesce(text, ''), ' ', {listed(r.SAMPLE_KEYWORDS)}[doc_id % {len(r.SAMPLE_KEYWORDS)} + 1]) AS title, source AS description FROM documents)"
ID = "substr(md5(coalesce(url, '')), 1, 11)"
URLS = f"""urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', {ID}, '&t=3') WHEN 1 THEN concat('https://youtu.be/', {ID}, '?si=x')
  WHEN 2 THEN concat('https://m.youtube.com/shorts/', {ID}) WHEN 3 THEN concat('https://youtube.com/embed/', {ID}, '?a=b') WHEN 4 THEN concat('https://music.youtube.com/live/', {ID})
  WHEN 5 THEN concat('http://www.youtube.com/v/', {ID}) WHEN 6 THEN {ID} ELSE url END AS url, {ID} AS id FROM pages)"""
LOOSE = "CASE WHEN page_id % 8 IN (0, 1, 2, 3) THEN id END"
STRICT = "CASE WHEN page_id % 8 <= 6 THEN id END"
TOP_TITLES = "top_titles AS (SELECT channel_id, list(title ORDER BY views DESC, pos)[1:10] AS top_titles FROM recent GROUP BY channel_id)"
RECENT = "recent AS (SELECT channel_id, CAST(pos AS INTEGER) AS pos, video_id, title, views, likes, comments FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY k, video_id) AS pos FROM videos) WHERE pos <= 12)"
INTROS = """intros AS (
  SELECT s.subject_id, e.user_id % 10 = 9 AS failed, CASE WHEN e.user_id % 10 = 9 THEN 0 ELSE least(e.n, 15) END AS n_frames
  FROM (SELECT subject_id, k % n AS video_no FROM subjects, n_users) s LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = s.video_no)"""
ANSWERS = """answers AS (
  SELECT conv_id, turn, conv_id % 7 = 0 AS broken, turn AS t, length(text) AS n FROM conversations WHERE role = 'assistant')"""


def sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    from vidcohort.plans import oracle_more, oracle_report

    search = (VIDEOS, SUBJECTS, TITLE_QUERIES, SEARCH)
    hyp_search = (VIDEOS, SUBJECTS, HYPOTHESES, SEARCH)
    full = (*search, COHORT)
    feats = (*full, FRAMES, intro("intro15", 15), intro("intro8", 8), USERS, summary("users", "subjects", "intro15", "s.subject_id".replace("s.", "")), summary("bench", "videos", "intro8", "video_id"), MEMBERS)
    long = (*feats, unpivot("user_long", "users", "subject_id"), unpivot("member_long", "members", "subject_id, grp, pos"), DOMINANT)
    compared = (*long, CONTRAST)
    judged = (*compared, CONFIDENCE)
    center = lambda k: first_rule("lower(concat(title, ' ', description))", r.EMOTIONAL_CENTERS, r.DEFAULT_CENTER, k)
    names = {"center": "center", "desire": "audience_desire", "advantage": "creator_advantage", "direction": "growth_direction"}
    names |= {f"{k}_lower": f"lower({v})" for k, v in names.items()} | {k: q(v.lower()) for k, v in r.VISION_STUB.items()}
    story = ", ".join(f"{filled(template, **names)} AS {name}" for name, template in r.NARRATIVE.items())
    own = "own AS (SELECT s.*, top_titles, array_to_string(top_titles[1:8], ' ') AS t8, array_to_string(top_titles[1:10], ' ') AS t10 FROM subjects s LEFT JOIN top_titles USING (channel_id))"
    at = {"world": "lower(concat(title, '  ', channel_id, '  ', t8))", "style": "lower(concat(title, '  ', t8))", "pull": "lower(concat(t10, ' ', title))", "patterns": "lower(concat(title, ' ', t10))"}
    picked = {"channel": "channel_id", "title": "title", "world": first_rule(at["world"], r.CONTENT_WORLDS, r.DEFAULT_WORLD, 0)}
    picked |= {n: first_rule(at["style"], r.EMOTIONAL_STYLES, r.DEFAULT_STYLE, i) for i, n in enumerate(("label", "feeling", "viewer_feeling"))}
    picked |= {n: first_rule(at["pull"], r.AUDIENCE_PULLS, r.DEFAULT_PULL, i) for i, n in enumerate(("pull", "why"))}
    patterns = lambda c: f"list_filter([{', '.join(f'CASE WHEN {any_of(c, k)} THEN {q(p)} END' for p, k in r.PATTERNS)}], lambda x: x IS NOT NULL)"
    chosen = lambda c: f"CASE WHEN len({patterns(c)}) > 0 THEN {patterns(c)} ELSE {listed(r.DEFAULT_PATTERNS)} END"
    bullets = f"array_to_string(list_transform({chosen(at['patterns'])}, lambda p: '• ' || upper(substr(p, 1, 1)) || lower(substr(p, 2))), chr(10))"
    nl = "' || chr(10) || '"
    head, tail = q(r.PATTERN_HEAD).replace("\n", nl), q(r.PATTERN_TAIL).replace("\n", nl)
    dna = ", ".join(f"{squeezed(filled(template, **{k: '(' + v + ')' for k, v in picked.items()}))} AS {name}" for name, template in r.DNA.items())
    rate = "CASE WHEN views > 0 THEN CAST(likes + comments AS DOUBLE) / views * 100 ELSE 0 END"
    say = lambda *parts: " || ".join(p[1:] if p[0] == "$" else q(p) for p in parts)
    tips = f"""SELECT subject_id, feature_ord, {say('Experiment with ', '$label')} AS title,
      {say("Top benchmark intros most often showed '", '$top_dominant_value', "', while lower benchmark intros most often showed '", '$lower_dominant_value', "'. Your intro showed '", '$user_value', "'.")} AS evidence,
      {q('This is an observed difference between benchmark groups. It does not establish cause, but it is worth testing.')} AS why_it_matters,
      {say('Test an opening segment closer to the top benchmark pattern for ', '$label', '.')} AS suggested_test, 'limited' AS confidence FROM contrast WHERE status IN ('missing_winning_feature', 'risk_signal')"""
    reason = "CASE confidence " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in r.CONFIDENCE.items()) + " END"
    final = f"""CASE WHEN confidence = 'low' THEN 'The available benchmark evidence is too limited for a clear position.'
      WHEN risks > 0 THEN 'Your intro matches ' || risks || ' lower-benchmark pattern(s), misses ' || missing || ' top-benchmark pattern(s), and aligns with ' || aligned || ' top-benchmark pattern(s).'
      WHEN missing > 0 THEN 'Your intro misses ' || missing || ' top-benchmark pattern(s) and aligns with ' || aligned || ' top-benchmark pattern(s).'
      WHEN aligned > 0 THEN 'Your intro aligns with the strongest actionable benchmark patterns the engine could reliably compare.'
      ELSE 'No clear actionable difference was found from the current benchmark evidence.' END"""
    columns = "subject_id, grp, CAST(rank AS INTEGER) AS rank, video_id, views, overlap"
    feature_columns = ", ".join(["frames_analyzed", "scene_changes", "scene_change_count", *features.CLASSES])
    found = {
        "safe_int": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) ELSE 0 END AS n FROM events",
        "clean_text": """SELECT page_id, md5(regexp_replace(replace(replace(replace(regexp_replace(html, '<.*?>', '', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM pages""",
        "video_id_loose": sql(URLS, f"SELECT page_id, {LOOSE} AS video_id FROM urls"),
        "video_id_strict": sql(URLS, f"SELECT page_id, {STRICT} AS video_id FROM urls"),
        "canonical_url": sql(URLS, f"SELECT page_id, {q(t.WATCH)} || {STRICT} AS url, CASE WHEN page_id % 8 = 7 THEN 'invalid_youtube_url' END AS error_type FROM urls"),
        "normalize_text": f"SELECT doc_id, md5({norm('text')}) AS normalized_md5 FROM documents",
        "word_set": f"SELECT doc_id, CAST(len({word_list('text')}) AS INTEGER) AS n_words, md5(array_to_string(list_sort({word_list('text')}), ' ')) AS words_md5 FROM documents",
        "title_query": sql(VIDEOS, SUBJECTS, TITLE_QUERIES, "SELECT * FROM queries"),
        "query_hypotheses": sql(VIDEOS, SUBJECTS, HYPOTHESES, "SELECT * FROM hyp WHERE qpos < 8"),
        "token_overlap": sql(*search, "SELECT subject_id, qpos, video_id, overlap FROM pairs"),
        "candidate_search": sql(*search, "SELECT * FROM candidates"),
        "query_scores": sql(*hyp_search, "SELECT * FROM scores"),
        "best_query": sql(*hyp_search, "SELECT * FROM best"),
        "clean_cohort": sql(*full, "SELECT subject_id, pos, video_id, overlap, views, CAST(rank AS INTEGER) AS rank FROM cleaned"),
        "top_performers": sql(*full, f"SELECT {columns} FROM performers WHERE grp = 'top'"),
        "lower_performers": sql(*full, f"SELECT {columns}, reason FROM performers JOIN reasons USING (subject_id) WHERE grp = 'lower'"),
        "lower_strict": sql(*full, f"SELECT {columns} FROM performers JOIN sizes USING (subject_id) WHERE grp = 'lower' AND n_strict >= 3"),
        "lower_fallback": sql(*full, f"SELECT {columns} FROM performers JOIN sizes USING (subject_id) WHERE grp = 'lower' AND n_strict < 3"),
        "cohort_summary": sql(*full, f"""SELECT s.subject_id, coalesce(b.query, '') AS query, coalesce(b.score, 0) AS score, (SELECT count(*) FROM of_best o WHERE o.subject_id = s.subject_id) AS candidate_count,
          (SELECT count(*) FROM cleaned c WHERE c.subject_id = s.subject_id) AS cleaned_count, coalesce(reason, {q(cohort.TOO_FEW)}) AS lower_performer_reason,
          coalesce((SELECT string_agg(video_id, ',' ORDER BY rank) FROM performers p WHERE p.subject_id = s.subject_id AND grp = 'top'), '') AS top_ids,
          coalesce((SELECT string_agg(video_id, ',' ORDER BY rank) FROM performers p WHERE p.subject_id = s.subject_id AND grp = 'lower'), '') AS lower_ids
          FROM subjects s LEFT JOIN best b ON b.subject_id = s.subject_id LEFT JOIN reasons r ON r.subject_id = s.subject_id"""),
        "recent_uploads": sql(VIDEOS, RECENT, "SELECT * FROM recent"),
        "video_context": sql(VIDEOS, CHANNELS, SUBJECTS, RECENT, """SELECT subject_id, video_id, title, views, s.channel_id, s.channel_id AS channel_name, subscribers, (SELECT count(*) FROM recent r WHERE r.channel_id = s.channel_id) AS recent_count, 'success' AS status
          FROM subjects s JOIN channels c ON c.channel_id = s.channel_id"""),
        "ingest_videos": sql(VIDEOS, "SELECT video_id, title, channel_id, views, likes, comments, 'https://img/' || video_id AS thumbnail FROM videos"),
        "ingest_channels": sql(VIDEOS, CHANNELS, "SELECT channel_id, channel_id AS title, subscribers, 'u' || channel_id AS uploads_playlist_id FROM channels"),
        "parse_observations": sql(ANSWERS, """SELECT conv_id, turn, CASE WHEN broken THEN 'failed' ELSE 'success' END AS status, CASE WHEN NOT broken THEN 't' || t END AS opening_type,
          CASE WHEN NOT broken THEN 'w' || n END AS visual_focus, CASE WHEN broken THEN 'low' ELSE 'high' END AS confidence FROM answers"""),
        "frame_diff": """WITH g AS (SELECT vec_id // 10 AS video_no, vec_id % 10 AS frame_no, list_transform(embedding, lambda x: greatest(0, least(255, 128 + 400 * CAST(x AS DOUBLE)))) AS grid FROM embeddings),
          p AS (SELECT *, lag(grid) OVER (PARTITION BY video_no ORDER BY frame_no) AS before FROM g)
          SELECT video_no, frame_no, CASE WHEN before IS NOT NULL THEN round(list_sum(list_transform(range(1, 65), lambda i: abs(grid[i] - before[i]))) / 64, 6) END AS diff FROM p""",
        "majority_class": sql(FRAMES, f"SELECT video_no, v AS dominant_color_feel FROM (SELECT video_no, v, row_number() OVER (PARTITION BY video_no ORDER BY count(*) DESC, min(frame_no)) AS n FROM (SELECT video_no, frame_no, {COLOR} AS v FROM frames) GROUP BY video_no, v) WHERE n = 1"),
        "intro_features": sql(FRAMES, intro("intro15", 15), "SELECT * FROM intro15"),
        "feature_summary": sql(VIDEOS, SUBJECTS, FRAMES, intro("intro15", 15), USERS, summary("users", "subjects", "intro15", "subject_id"), "SELECT * FROM users"),
        "feature_long": sql(VIDEOS, SUBJECTS, FRAMES, intro("intro15", 15), USERS, summary("users", "subjects", "intro15", "subject_id"), unpivot("user_long", "users", "subject_id"), "SELECT * FROM user_long"),
        "cohort_features": sql(*feats, f"SELECT subject_id, grp, CAST(pos AS INTEGER) AS pos, video_id, {feature_columns} FROM members"),
        "dominant_values": sql(*long, "SELECT * FROM dominant"),
        "feature_contrast": sql(*compared, "SELECT * FROM contrast"),
        "recommendations": sql(*compared, tips),
        "confidence": sql(*judged, f"SELECT subject_id, top_count, lower_count, usable, confidence, {reason} AS confidence_reason FROM levels"),
        "verdict": sql(*judged, f"SELECT subject_id, aligned, missing, risks, {final} AS final_verdict FROM levels"),
        "content_world": sql(KEYWORD_VIDEOS, f"SELECT doc_id, {first_rule('lower(title)', r.CONTENT_WORLDS, r.DEFAULT_WORLD, 0)} AS world FROM kv"),
        "emotional_style": sql(KEYWORD_VIDEOS, "SELECT doc_id, " + ", ".join(f"{first_rule('lower(title)', r.EMOTIONAL_STYLES, r.DEFAULT_STYLE, i)} AS {n}" for i, n in enumerate(("label", "feeling", "viewer_feeling"))) + " FROM kv"),
        "audience_pull": sql(KEYWORD_VIDEOS, "SELECT doc_id, " + ", ".join(f"{first_rule('lower(title)', r.AUDIENCE_PULLS, r.DEFAULT_PULL, i)} AS {n}" for i, n in enumerate(("pull", "why"))) + " FROM kv"),
        "repeatable_patterns": sql(KEYWORD_VIDEOS, f"SELECT doc_id, array_to_string({chosen('lower(title)')}, '; ') AS patterns FROM kv"),
        "emotional_center": sql(KEYWORD_VIDEOS, "SELECT doc_id, " + ", ".join(f"{center(i)} AS {n}" for i, n in enumerate(("center", "audience_desire", "creator_advantage", "growth_direction"))) + " FROM kv"),
        "top_titles": sql(VIDEOS, RECENT, TOP_TITLES, "SELECT channel_id, array_to_string(top_titles, ' / ') AS top_titles FROM top_titles"),
        "content_dna": sql(VIDEOS, SUBJECTS, RECENT, TOP_TITLES, own, f"SELECT video_id, {dna}, {head} || {bullets} || {tail} AS repeatable_pattern FROM own"),
        "growth_snapshot": sql(VIDEOS, CHANNELS, f"""SELECT video_id, {rate} AS engagement_rate,
          CASE WHEN views > subscribers * 0.25::DOUBLE THEN {q(r.MOMENTUM[0])} WHEN views > subscribers * 0.1::DOUBLE THEN {q(r.MOMENTUM[1])} ELSE {q(r.MOMENTUM[2])} END AS current_momentum,
          CASE WHEN {any_of('lower(title)', r.MOMENT_WORDS)} THEN {q(r.STRENGTH[0])} ELSE {q(r.STRENGTH[1])} END AS strongest_area,
          CASE WHEN {rate} < 2 THEN {q(r.OPPORTUNITY[0])} WHEN {rate} < 5 THEN {q(r.OPPORTUNITY[1])} ELSE {q(r.OPPORTUNITY[2])} END AS growth_opportunity, {q(r.NEXT_MOVE)} AS next_best_move FROM videos JOIN channels USING (channel_id)"""),
        "narrative": sql(KEYWORD_VIDEOS, "cv AS (SELECT doc_id, " + ", ".join(f"{center(i)} AS {n}" for i, n in enumerate(("center", "audience_desire", "creator_advantage", "growth_direction"))) + " FROM kv)", f"SELECT doc_id AS video_id, center, audience_desire, creator_advantage, growth_direction, '{', '.join(r.CURRENCY)}' AS emotional_currency, {story} FROM cv"),
        "vision_stub": sql(FRAMES, "SELECT CAST(video_no AS VARCHAR) AS video_id, count(*) AS frame_count, string_agg('frame_' || lpad(CAST(frame_no AS VARCHAR), 3, '0'), ',' ORDER BY frame_no) FILTER (WHERE frame_no <= 10) AS frames_analyzed, " + ", ".join(f"{q(v)} AS {k}" for k, v in r.VISION_STUB.items()) + f", true AS is_placeholder, {q(r.VISION_NOTE)} AS note FROM frames GROUP BY video_no"),
        "evidence_best": """SELECT video_id, method, 1 AS schema_version, CASE WHEN video_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS completeness FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE method WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, method) AS n FROM
          (SELECT DISTINCT user_id AS video_id, event_type AS method FROM events WHERE event_id % 3 <> 0)) WHERE n = 1""",
        "evidence_failures": """SELECT event_type AS method, CAST(user_id % 4 AS VARCHAR) AS platform, count(*) AS attempts, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS failure_rate FROM events GROUP BY CUBE (event_type, CAST(user_id % 4 AS VARCHAR))""",
        "frame_metrics": """WITH g AS (SELECT CAST(vec_id // 10 AS VARCHAR) AS video_id, CAST(vec_id % 10 AS INTEGER) AS frame_no,
            list_transform(embedding, lambda x: greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 400 * CAST(x AS DOUBLE)))) AS grid FROM embeddings),
          p AS (SELECT video_id, frame_no, unnest(grid) AS x FROM g)
          SELECT video_id, frame_no, round(avg(round_even(0.114::DOUBLE * floor(x / 2) + 0.587::DOUBLE * floor(x) + 0.299::DOUBLE * floor(x), 0)), 6) AS luma,
            CASE WHEN count(*) FILTER (WHERE floor(x) >= 1) > 0 THEN 30.0::DOUBLE END AS mean_hue, count(*) FILTER (WHERE floor(x) >= 1) AS valid_px, 14400 AS grid_px
          FROM p GROUP BY video_id, frame_no""",
        "report_status": sql(*feats, INTROS, f"""SELECT subject_id, CASE WHEN warnings = '' THEN 'success' ELSE 'partial' END AS status, warnings, has_intro FROM (
          SELECT s.subject_id, coalesce(n_frames, 0) > 0 AS has_intro, concat_ws('; ', CASE WHEN failed THEN 'The intro could not be acquired.' END,
            CASE WHEN (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'top') = 0 THEN {q(report.NO_TOP)} END,
            CASE WHEN (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'lower') = 0 THEN {q(report.NO_LOWER)} END) AS warnings
          FROM subjects s LEFT JOIN intros USING (subject_id))"""),
        "observation_status": sql(VIDEOS, SUBJECTS, USERS, INTROS, ANSWERS, f"""firsts AS (SELECT conv_id, arg_min(t, turn) AS t, arg_min(n, turn) AS n, bool_or(broken) AS broken FROM answers GROUP BY conv_id),
          convs AS (SELECT max(conv_id) + 1 AS m FROM conversations)""", f"""SELECT subject_id, CASE WHEN fine THEN 'success' ELSE 'failed' END AS status, CASE WHEN fine THEN 't' || t END AS opening_type,
            CASE WHEN fine THEN 'w' || n END AS visual_focus, CASE WHEN fine THEN 'high' ELSE 'low' END AS confidence,
            CASE WHEN n_frames <= 0 THEN {q(ingest.NO_FRAMES)} WHEN NOT fine THEN 'VLM observation failed' END AS warning
          FROM (SELECT s.subject_id, coalesce(n_frames, 0) AS n_frames, t, f.n, coalesce(n_frames, 0) > 0 AND coalesce(NOT broken, false) AS fine
            FROM subjects s CROSS JOIN convs LEFT JOIN intros USING (subject_id) LEFT JOIN firsts f ON f.conv_id = s.k % m)"""),
        "job_states": f"""SELECT job_id, coalesce(arg_min(state, seq) FILTER (WHERE list_contains({listed(jobs.FINAL)}, state)), arg_max(state, seq)) AS state, count(*) AS reports,
            bool_or(list_contains({listed(jobs.FINAL)}, state)) AS finished
          FROM (SELECT user_id AS job_id, event_id AS seq, {listed(jobs.STATES)}[CASE WHEN event_id % 50 = 0 THEN 5 + user_id % 3 ELSE 1 + event_id % 4 END] AS state FROM events) GROUP BY job_id""",
        "display_formats": sql(VIDEOS, """SELECT video_id, array_to_string(list_transform(regexp_extract_all(title, '\\p{L}+|\\P{L}+'), lambda p: upper(p[1]) || lower(p[2:])), '') AS shown_title,
          format('{:,}', views) AS shown_views FROM videos"""),
        "feature_shapes": sql(VIDEOS, SUBJECTS, FRAMES, intro("intro15", 15), USERS, summary("users", "subjects", "intro15", "subject_id"), "SELECT * FROM users"),
    } | oracle_more.oracle_sql(feats)
    return found | {"report_values": oracle_report.sql(found, judged, tips, final)}
