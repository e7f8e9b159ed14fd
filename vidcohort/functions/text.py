"""Text and URL functions, each from columns to a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that describe the packaging of a video rather than its subject.
WEAK_WORDS = [
    "official", "trailer", "teaser", "promo", "reaction", "reacting", "breakdown", "review", "explained", "analysis", "details",
    "nuevo", "nueva", "full", "video", "clip", "scene", "now", "playing", "super", "wiki", "hd", "4k", "8k", "shorts", "ytshorts",
    "viral", "trending",
]
# Hosts of the strict parser and its path forms.
STRICT_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]
PATH_FORMS = ["shorts", "embed", "live", "v"]
WATCH = "https://www.youtube.com/watch?v="
ID = "^[A-Za-z0-9_-]{11}$"
MAX_HYPOTHESES = 8


def text(c: Column) -> Column:
    """The text, or an empty one instead of null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def safe_int(c: Column) -> Column:
    """Whole number in a string; 0 if there is none."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def strip(c: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clean_markup(c: Column) -> Column:
    """Tags out, three entities decoded (the ampersand first), ends trimmed."""
    out = F.regexp_replace(text(c), r"(?d)<.*?>", "")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def normalized(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and blanks becomes a blank; blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    parts = F.regexp_extract_all(text(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def thousands(c: Column) -> Column:
    """A whole number with commas; 0 if there is none."""
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def word_set(c: Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalized(c), " "), lambda x: x != ""))


def title_text(c: Column) -> Column:
    """Links out; letters, digits and the marks that split titles stay."""
    out = F.regexp_replace(text(c), r"http\S+", " ")
    out = F.regexp_replace(out, r"[^a-zA-Z0-9\s|:\-']", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def query_text(c: Column) -> Column:
    """Letters and digits only, blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"[^a-zA-Z0-9\s]", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def strong_words(c: Column) -> Column:
    """The query without weak words."""
    weak = F.array(*map(F.lit, WEAK_WORDS))
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(weak, F.lower(w))), " ")


def hypotheses(title: Column, description: Column) -> Column:
    """Search queries of a title: each part without weak words and as it is, then the whole title; the
    first spelling of each counts, at most eight. If there is none, the whole text."""
    clean = title_text(title)
    parts = F.transform(F.split(clean, r"[|:\-]"), query_text)
    both = F.flatten(F.transform(F.concat(parts, F.array(query_text(clean))), lambda q: F.array(strong_words(q), q)))
    usable = F.filter(both, lambda q: F.size(words(q)) >= 2)
    first = F.filter(F.transform(usable, lambda q, i: F.struct(q.alias("q"), i.alias("i"))), lambda x: F.array_position(F.transform(usable, F.lower), F.lower(x["q"])) == x["i"] + 1)
    found = F.slice(F.transform(first, lambda x: x["q"]), 1, MAX_HYPOTHESES)
    whole = query_text(F.when(text(title) != "", text(title)).otherwise(text(description)))
    strong = strong_words(whole)
    last = F.when(strong != "", strong).otherwise(whole)
    none = F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).when(last != "", F.array(last)).otherwise(none)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_video(url: Column) -> Column:
    """The first value of the parameter v; empty if there is none."""
    query = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    return F.coalesce(F.try_url_decode(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)), F.lit(""))


def video_id_loose(url: Column) -> Column:
    """Id in a URL of any host that has youtube.com in it, or of the short host; null if there is none."""
    host, path = url_host(url), url_path(url)
    shorts, embed = F.regexp_extract(path, "/shorts/([^/?]+)", 1), F.regexp_extract(path, "/embed/([^/?]+)", 1)
    wide = F.when(url_video(url) != "", url_video(url)).when(shorts != "", shorts).when(embed != "", embed)
    return F.when(host.isin(SHORT_HOSTS), F.regexp_replace(path, "^/+|/+$", "")).when(host.contains("youtube.com"), wide)


def video_id_strict(value: Column) -> Column:
    """An 11-character id, alone or in a URL of a known host; null if there is none."""
    raw = F.trim(value)
    host, path = url_host(raw), url_path(raw)
    valid = lambda c: F.when(c.rlike(ID), c)
    short = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")[0]
    wide = F.when(url_video(raw).rlike(ID), url_video(raw))
    for form in PATH_FORMS:
        found = F.regexp_extract(path, f"^/{form}/([^/?#]+)", 1)
        wide = wide.when(found != "", valid(found))
    return F.when(raw.rlike(ID), raw).when(host.isin(SHORT_HOSTS), valid(short)).when(host.isin(STRICT_HOSTS), wide)


def canonical_url(value: Column) -> Column:
    """Watch URL, or null if no id can be told."""
    return F.concat(F.lit(WATCH), video_id_strict(value))


def any_of(c: Column, keywords: list[str]) -> Column:
    """Whether one of the keywords is a substring."""
    out = F.lit(False)
    for k in keywords:
        out = out | c.contains(k)
    return out


def json_text(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    out = strip(text(c))
    out = strip(F.regexp_replace(out, r"^```json", ""))
    out = strip(F.regexp_replace(out, r"^```", ""))
    return strip(F.regexp_replace(out, r"```$", ""))


def fill(template: str, **columns: Column) -> Column:
    """The template with its {names} taken from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
