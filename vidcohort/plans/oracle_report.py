"""DuckDB SQL of the whole report as (subject_id, section, path, value) rows."""

from __future__ import annotations

from vidcohort.functions import rules as r
from vidcohort.operators import features, semantic
from vidcohort.plans import oracle as o
from vidcohort.plans import oracle_more as more
from vidcohort.plans import report


def scalars(section: str, source: str, columns: list[str]) -> list[str]:
    return [f"SELECT subject_id, '{section}', '{c}', CAST({c} AS VARCHAR) FROM {source} WHERE {c} IS NOT NULL" for c in columns]


def items(section: str, path: str, source: str, columns: list[str], place: str) -> list[str]:
    """Rows of a list of structs; ``place`` counts from 0."""
    return [f"SELECT subject_id, '{section}', '{path}.' || CAST({place} AS VARCHAR) || '.{c}', CAST({c} AS VARCHAR) FROM {source} WHERE {c} IS NOT NULL" for c in columns]


def listed(section: str, path: str, source: str, value: str, place: str) -> list[str]:
    return [f"SELECT subject_id, '{section}', '{path}' || CAST({place} AS VARCHAR), CAST({value} AS VARCHAR) FROM {source} WHERE {value} IS NOT NULL"]


def sql(plain: dict[str, str], judged: tuple[str, ...], tips: str, final: str) -> str:
    """``plain`` are the other queries, ``judged`` the tables up to the levels of confidence, ``tips`` and ``final`` what is told of them."""
    # an intro that was not acquired has no value of any feature
    own = o.unpivot("all_long", "users", "subject_id")
    masked = "user_long AS (SELECT l.subject_id, feature_ord, feature, CASE WHEN coalesce(n_frames, 0) > 0 THEN value ELSE 'unknown' END AS value FROM all_long l LEFT JOIN intros USING (subject_id))"
    at = next(i for i, p in enumerate(judged) if p.startswith("user_long AS"))
    tables = [*judged[:at], own, o.INTROS, masked, *judged[at + 1 :]]
    has_intro = "(SELECT subject_id FROM intros WHERE coalesce(n_frames, 0) > 0)"
    narrative = plain["narrative"].replace(o.KEYWORD_VIDEOS, "kv AS (SELECT subject_id AS doc_id, title, '' AS description FROM subjects)")
    tables += [
        o.CHANNELS, o.RECENT, more.OBSERVED, more.POSITIONS, f"state AS ({plain['report_status']})",
        f"""told AS (SELECT subject_id, unnest(w) AS warning, unnest(range(len(w))) AS i FROM (SELECT s.subject_id, list_filter([CASE WHEN failed THEN 'The intro could not be acquired.' END,
          CASE WHEN (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'top') = 0 THEN {o.q(report.NO_TOP)} END,
          CASE WHEN (SELECT count(*) FROM members m WHERE m.subject_id = s.subject_id AND grp = 'lower') = 0 THEN {o.q(report.NO_LOWER)} END], lambda x: x IS NOT NULL) AS w FROM subjects s LEFT JOIN intros USING (subject_id)))""",
        "video_ AS (SELECT subject_id, video_id, title, '' AS description, channel_id, channel_id AS channel_title, views, likes, comments FROM subjects)",
        "channel_ AS (SELECT subject_id, c.channel_id, c.channel_id AS title, '' AS description, subscribers FROM subjects s JOIN channels c ON c.channel_id = s.channel_id)",
        "recent_ AS (SELECT s.subject_id, r.* FROM subjects s JOIN recent r ON r.channel_id = s.channel_id)",
        f"bench_ AS ({plain['cohort_summary']})",
        "members_ AS (SELECT subject_id, grp, CAST(pos AS INTEGER) AS pos, video_id, frames_analyzed, scene_change_count, " + ", ".join(features.CLASSES) + " FROM members)",
        f"dna_ AS (SELECT video_id AS subject_id, * EXCLUDE video_id FROM ({plain['content_dna']}))",
        f"growth_ AS (SELECT g.video_id AS subject_id, g.* EXCLUDE video_id FROM ({plain['growth_snapshot']}) g JOIN subjects s ON s.subject_id = g.video_id)",
        f"vision_ AS (SELECT subject_id, v.* FROM (SELECT subject_id, CAST(k % n AS VARCHAR) AS video_no FROM subjects, n_users) JOIN ({plain['vision_stub']}) v ON v.video_id = video_no JOIN {has_intro} USING (subject_id))",
        "seen_ AS (SELECT subject_id, unnest(string_split(frames_analyzed, ',')) AS origin, unnest(range(len(string_split(frames_analyzed, ',')))) AS i FROM vision_)",
        f"story_ AS (SELECT n.video_id AS subject_id, n.* EXCLUDE video_id FROM ({narrative}) n JOIN {has_intro} h ON h.subject_id = n.video_id)",
        f"currency_ AS (SELECT subject_id, unnest({o.listed(r.CURRENCY)}) AS word, unnest(range({len(r.CURRENCY)})) AS i FROM story_)",
        f"features_ AS (SELECT u.* FROM users u JOIN {has_intro} USING (subject_id))",
        f"observed_ AS (SELECT b.* FROM ({plain['observation_status']}) b JOIN {has_intro} USING (subject_id))",
        f"compared_ AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ord) - 1 AS i FROM positions WHERE {more.KNOWN})",
        f"differs_ AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ord) - 1 AS j FROM compared_ WHERE top_medoid <> lower_medoid)",
        f"ready_ AS (SELECT s.subject_id, CASE WHEN n > 0 THEN 'ready' ELSE 'not_ready' END AS status, CASE WHEN coalesce(n, 0) = 0 THEN {o.q(semantic.NOT_READY)} END AS warning FROM subjects s LEFT JOIN (SELECT subject_id, count(*) AS n FROM compared_ GROUP BY subject_id) USING (subject_id))",
        "levels_ AS (SELECT subject_id, confidence, CASE confidence " + " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in r.CONFIDENCE.items()) + f" END AS confidence_reason, {final} AS final_verdict FROM levels)",
        f"tips_ AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY feature_ord) - 1 AS i FROM ({tips}))",
    ]
    names = ["pos", "video_id", "frames_analyzed", "scene_change_count", *features.CLASSES]
    rows = [
        "SELECT subject_id, 'status' AS section, '' AS path, status AS value FROM state", *listed("warnings", "", "told", "warning", "i"),
        *scalars("video", "video_", ["video_id", "title", "description", "channel_id", "channel_title", "views", "likes", "comments"]),
        *scalars("channel", "channel_", ["channel_id", "title", "description", "subscribers"]),
        *items("recent_videos", "recent_videos", "recent_", ["pos", "video_id", "title", "views", "likes", "comments"], "pos - 1"),
        *listed("category", "queries.", "queries", "query", "qpos"),
        *scalars("benchmark", "bench_", ["query", "candidate_count", "cleaned_count", "lower_performer_reason"]),
        *items("benchmark", "query_scores", "scores", ["qpos", "query", "score"], "qpos"),
        *[x for g in ("top", "lower") for x in listed("benchmark", f"{g}_ids.", f"(SELECT * FROM performers WHERE grp = '{g}')", "video_id", "rank - 1")],
        *[x for g in ("top", "lower") for x in items("benchmark_features", f"{g}_performers", f"(SELECT * FROM members_ WHERE grp = '{g}')", names, "pos - 1")],
        *scalars("content_dna", "dna_", [*r.DNA, "repeatable_pattern"]),
        *scalars("growth_snapshot", "growth_", ["engagement_rate", "current_momentum", "strongest_area", "growth_opportunity", "next_best_move"]),
        *scalars("vision", "vision_", ["frame_count", *r.VISION_STUB, "is_placeholder", "note"]), *listed("vision", "frames_analyzed.", "seen_", "origin", "i"),
        *scalars("narrative", "story_", ["center", "audience_desire", "creator_advantage", "growth_direction", *r.NARRATIVE]), *listed("narrative", "emotional_currency.", "currency_", "word", "i"),
        *scalars("feature_report", "features_", ["frames_analyzed", "scene_changes", "scene_change_count", *features.CLASSES]),
        *scalars("intro_observation", "observed_", ["status", "opening_type", "visual_focus", "confidence", "warning"]),
        *scalars("semantic_comparison", "ready_", ["status"]), *listed("semantic_comparison", "warnings.", "ready_", "warning", "0"),
        *listed("semantic_comparison", "user_position.", "compared_", "field || ': ' || position", "i"),
        *listed("semantic_comparison", "semantic_differences.", "differs_", "field || ': top ''' || top_medoid || ''', lower ''' || lower_medoid || ''''", "j"),
        *items("patterns", "feature_comparison", "contrast", ["feature_ord", "feature", "label", "user_value", "status", "explanation"], "feature_ord"),
        *items("patterns", "recommendations", "tips_", ["feature_ord", "title", "evidence", "why_it_matters", "suggested_test", "confidence"], "i"),
        *scalars("patterns", "levels_", ["confidence", "confidence_reason", "final_verdict"]),
    ]
    return o.sql(*tables, "\nUNION ALL ".join(rows))

