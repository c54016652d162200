"""Text, key and date functions of the posting and place-name pipelines."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .kernels import lit


@F.pandas_udf(StringType())
def strip_accents(values: pd.Series) -> pd.Series:
    """Without combining marks; the one thing here that Spark has no function for."""
    return values.str.normalize("NFD").str.replace(r"[̀-ͯ]", "", regex=True)


def slug(name) -> Column:
    """Lower case, accents off, spaces as underscores."""
    return F.replace(strip_accents(F.lower(lit(name))), F.lit(" "), F.lit("_"))


def first_word(x) -> Column:
    return F.get(F.split(F.lower(lit(x)), " "), F.lit(0))


def collapse_spaces(x) -> Column:
    return F.trim(F.regexp_replace(lit(x), r"[ \t]+", " "))


def html_text(html) -> Column:
    """Tags off, the common entities decoded, blank lines collapsed."""
    x = F.regexp_replace(lit(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n\s*", "\n"), r"^\s+|\s+$", "")


def strip_html(html) -> Column:
    """Entities decoded, tags off, the texts between tags on lines of their own; at most one blank line in a row."""
    x = lit(html)
    for entity, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?:<[^>]*>)+", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def truncate_sentences(text, sentences: int = 2, chars: int = 320) -> Column:
    """At most so many sentences and characters."""
    parts = F.split(F.trim(lit(text)), r"(?<=[.!?])\s+")
    short = F.array_join(F.slice(parts, 1, sentences), " ")
    return F.when(F.length(short) > chars, F.concat(F.rtrim(F.substring(short, 1, chars - 1)), F.lit("…"))).otherwise(short)


def any_word(text, words: Sequence[str]) -> Column:
    """Whole words or phrases, any case."""
    body = "|".join(sorted((w.replace(".", r"\.").replace("+", r"\+") for w in words), key=len, reverse=True))
    return lit(text).rlike(rf"(?i)\b(?:{body})\b") if words else F.lit(False)


def title_gate(title, include: Sequence[str], exclude: Sequence[str], seniority: Sequence[str]) -> tuple[Column, Column]:
    """(passes, reason): excluded words first, then seniority, then whether an included word is there."""
    t = F.coalesce(lit(title), F.lit(""))
    reason = (
        F.when(F.trim(t) == "", "empty").when(any_word(t, exclude), "exclude").when(any_word(t, seniority), "seniority")
        .when(any_word(t, include), "include").otherwise("no_match")
    )
    return reason == "include", reason


def content_hash(text) -> Column:
    return F.sha2(F.coalesce(lit(text), F.lit("")), 256)


def iso_week(day) -> Column:
    """`2025-W01`: ISO year and week."""
    d = lit(day)
    return F.when(d.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d)))


def plain_key(x) -> Column:
    """Lower case letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(lit(x), F.lit(""))), r"[^a-z0-9]+", " "))


def squeeze(x) -> Column:
    """Lower case, trimmed, white space to single spaces."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(lit(x), F.lit("")))), r"\s+", " ")


def canonical_key(company, title, location, day) -> Column:
    """Half a SHA-256 of organisation, title, last part of the place and ISO week."""
    place = F.coalesce(F.element_at(F.filter(F.transform(F.split(squeeze(location), ","), lambda p: F.trim(p)), lambda p: p != ""), -1), F.lit(""))
    parts = [squeeze(company), squeeze(title), place, F.coalesce(iso_week(day), F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def source_priority(source, order: Sequence[str]) -> Column:
    """Place in the list from 0; unknown sources come after all."""
    at = F.array_position(F.array(*map(F.lit, order)), lit(source))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("long")


def tokens(name) -> Column:
    return F.array_distinct(F.filter(F.split(plain_key(name), " "), lambda t: t != ""))


def names_align(a, b, generic: Sequence[str]) -> Column:
    """They share a token that is not generic, or are equal."""
    drop = F.array(*map(F.lit, generic)) if generic else F.array().cast("array<string>")
    shared = F.array_intersect(F.array_except(tokens(a), drop), F.array_except(tokens(b), drop))
    return (plain_key(a) == plain_key(b)) | (F.size(shared) > 0)


def slug_aligns(slug_col, company, share: float = 0.5) -> Column:
    """One contains the other without separators, and is at least `share` of its length."""
    a, b = (F.regexp_replace(F.lower(lit(x)), r"[^a-z0-9]", "") for x in (slug_col, company))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (short > 0) & (a.contains(b) | b.contains(a)) & (short >= share * long)


def slug_candidates(company) -> Column:
    """Distinct board names a company may use, best first."""
    words = tokens(company)
    bare = F.array_except(words, F.array(*map(F.lit, ("inc", "ltd", "llc", "gmbh", "ag", "co", "corp"))))
    forms = [F.array_join(bare, ""), F.array_join(bare, "-"), F.array_join(words, ""), F.array_join(words, "-"), F.get(bare, F.lit(0))]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def parse_board_url(url) -> tuple[Column, Column]:
    """(kind, slug) of the address of a hosted job board."""
    u = F.lower(F.coalesce(lit(url), F.lit("")))
    rules = (
        ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"), ("lever", r"jobs(?:\.eu)?\.lever\.co/([a-z0-9_.-]+)"),
        ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_.%-]+)"), ("workable", r"apply\.workable\.com/([a-z0-9_-]+)"), ("recruitee", r"//([a-z0-9-]+)\.recruitee\.com"),
        ("personio", r"//([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"), ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_-]+)"),
        ("bamboohr", r"//([a-z0-9-]+)\.bamboohr\.com"), ("breezy", r"//([a-z0-9-]+)\.breezy\.hr"), ("jazzhr", r"//([a-z0-9-]+)\.applytojob\.com"), ("teamtailor", r"//([a-z0-9-]+)\.teamtailor\.com"),
    )
    kind, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        hit = F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))
        kind, found = F.when(hit.isNotNull(), name).otherwise(kind), F.when(hit.isNotNull(), hit).otherwise(found)
    return kind, found


def flexible_timestamp(hint) -> Column:
    """Epoch seconds or milliseconds, ISO, or RFC 822 (the weekday is not checked); NULL otherwise."""
    h = F.trim(lit(hint))
    number = F.when(h.rlike(r"^\d{9,13}$"), h.try_cast("long"))
    epoch = F.when(F.length(h) >= 12, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    mail = F.regexp_replace(F.regexp_replace(h, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    iso = F.when(h.rlike(r"^\d{4}-\d{2}-\d{2}"), h.try_cast("timestamp"))
    rfc = F.try_to_timestamp(F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), mail), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(epoch, iso, rfc)


def us_date(x) -> Column:
    """`MM/DD/YYYY hh:mm:ss AM`: the date."""
    return F.to_date(F.try_to_timestamp(F.get(F.split(F.trim(lit(x)), " "), F.lit(0)), F.lit("M/d/yyyy")))


def within_last(day, target, days: int) -> Column:
    """The day is in so many days before the target, or on it; the target is given, so that runs agree."""
    return (lit(day) >= F.date_sub(lit(target), days)) & (lit(day) <= lit(target))


def time_window(x) -> tuple[Column, Column]:
    """Minutes of `HH:MM-HH:MM`, any dash."""
    parts = F.split(lit(x), r"\s*[–-]\s*")
    minute = lambda p: F.get(F.split(p, ":"), F.lit(0)).try_cast("int") * 60 + F.get(F.split(p, ":"), F.lit(1)).try_cast("int")
    return minute(F.get(parts, F.lit(0))), minute(F.get(parts, F.lit(1)))


def clean_answer(x) -> Column:
    """Leading numbering and quotes off, first sentence."""
    bare = F.regexp_replace(F.trim(lit(x)), r"^(?:\(?\d+[.)]|[-*•])\s*", "")
    bare = F.regexp_replace(bare, r"^[\"'“”]+|[\"'“”]+$", "")
    return F.trim(F.regexp_extract(bare, r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0))


def looks_like_posting(first_line, text) -> Column:
    """Three or more fields between bars, or two and a link."""
    fields = F.size(F.filter(F.split(F.coalesce(lit(first_line), F.lit("")), r"\|"), lambda p: F.trim(p) != ""))
    return (fields >= 3) | ((fields == 2) & F.coalesce(lit(text).rlike(r"https?://"), F.lit(False)))


def flags(conditions: dict) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())
