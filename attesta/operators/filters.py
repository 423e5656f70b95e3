"""Predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases of travel promotion in titles.
TRAVEL = (
    r"travel (?:guide|vlog)", r"walking tour", r"city (?:tour|walk)", r"virtual tour", r"things to do", r"places to visit", r"must[- ]visit", r"tourist attractions?",
    r"vacation (?:in|to)", r"holiday (?:in|to)", r"trip to", r"gu[ií]a de viaje", r"lugares para visitar", r"viaje a", r"guide de voyage", r"visiter [a-zà-ÿ]+",
    r"voyage [aà] ", r"roteiro de viagem", r"viagem (?:a|para)", r"passeio (?:em|por)", r"cosa vedere", r"guida turistica", r"stadtf[uü]hrung", r"reisevlog",
)
#: Words of public affairs in titles and descriptions.
CIVIC = (
    r"protest\w*", r"demonstrat\w*", r"manifest\w*", r"strike", r"strikes", r"gr[eè]ve\w*", r"greve\w*", r"huelga\w*", r"sciopero\w*", r"government", r"gouvernement",
    r"governo", r"gobierno", r"regierung", r"parliament", r"parlement", r"parlamento", r"election\w*", r"[eé]lection\w*", r"pol[ií]tic\w*", r"policy", r"politique",
    r"pol[ií]tica", r"security", r"s[eé]curit[eé]", r"seguran[çc]a", r"seguridad", r"war", r"guerre", r"guerra", r"conflict\w*", r"conflit\w*", r"migration",
    r"immigration", r"tax", r"imp[oô]t\w*", r"imposto\w*",
)


def key_exists(payload: Column, key: str) -> Column:
    """Whether a JSON object has the key, a null value included."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def tagged(payload: Column, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | key_exists(payload, k)
    return out


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def half_open(at: Column, start: Column | str, end: Column | str) -> Column:
    start = F.lit(start).cast("timestamp") if isinstance(start, str) else start
    end = F.lit(end).cast("timestamp") if isinstance(end, str) else end
    return (at >= start) & (at < end)


def date_facet(at: Column, facet: str, now: Column, start: str | None = None, end: str | None = None) -> Column:
    """all / day / 2days / week / custom; invalid dates pass under all only.

    Custom ends are whole days: the end is exclusive, one day after.
    """
    if facet == "all":
        return F.lit(True)
    if facet == "custom":
        ok = half_open(at, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    else:
        hours = {"day": 24, "2days": 48, "week": 168}[facet]
        ok = (at >= now - F.expr(f"interval {hours} hours")) & (at < now)
    return F.coalesce(ok, F.lit(False))


def in_window(day: Column, at: Column, precision: Column, start: Column, end: Column, zone: Column) -> Column:
    """Day-precise rows compare local dates, others instants; both ends included."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    return F.when(precision == "day", (day >= local(start)) & (day <= local(end))).otherwise((at >= start) & (at <= end))


def publishable_transcript(eligible: Column, language: Column, complete: Column, hash_: Column, segments: Column, quarantined: list[str]) -> Column:
    """Eligible, English, not known incomplete, not quarantined, some text."""
    text = F.exists(segments, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    good = F.coalesce(language, F.lit("en")).rlike("^en") & ~F.coalesce(complete, F.lit(True)).eqNullSafe(F.lit(False))
    held = F.coalesce(hash_.isin(quarantined), F.lit(False)) if quarantined else F.lit(False)
    return F.coalesce(eligible, F.lit(False)) & good & ~held & F.coalesce(text, F.lit(False))


def publishable_label(id_: Column, truncated: Column, quarantined: list[str]) -> Column:
    held = F.coalesce(id_.isin(quarantined), F.lit(False)) if quarantined else F.lit(False)
    return ~held & ~truncated.eqNullSafe(F.lit(True))


def caption_state(saved: Column, incomplete: Column, blocked: Column, unavailable: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(saved), "saved").when(yes(incomplete), "incomplete").when(yes(blocked), "blocked").when(yes(unavailable), "unavailable").otherwise("unverified")


def travel_only(title: Column, description: Column) -> Column:
    """Travel promotion in the title and nothing of public affairs in title or description."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    words = lambda ws: r"(?U)\b(?:" + "|".join(ws) + r")\b"
    return plain(title).rlike(words(TRAVEL)) & ~F.concat_ws(" ", plain(title), plain(description)).rlike(words(CIVIC))


def iso_week_start(week: Column) -> Column:
    """Monday of ``yyyy-Www``; null when it does not parse."""
    year = F.try_to_number(F.regexp_extract(week, r"^(\d{4})-W\d{2}$", 1), F.lit("9999")).cast("int")
    number = F.try_to_number(F.regexp_extract(week, r"^\d{4}-W(\d{2})$", 1), F.lit("99")).cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    return F.when(number.between(1, 53), F.date_add(monday, (number - 1) * 7))


def retained_week(week: Column, today: Column, before: int = 30, after: int = 7) -> Column:
    at = iso_week_start(week)
    return F.coalesce((at >= F.date_sub(today, before)) & (at <= F.date_add(today, after)), F.lit(False))


def cooled_down(last_try: Column, quality_failure: Column, now: Column) -> Column:
    """Untried, or past 24 hours; past seven days after a quality failure."""
    wait = F.when(F.coalesce(quality_failure, F.lit(False)), F.expr("interval 7 days")).otherwise(F.expr("interval 1 day"))
    return last_try.isNull() | (last_try + wait <= now)


def allow(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def prune_structs(items: Column, fields: list[str]) -> Column:
    return F.transform(items, lambda r: F.struct(*(r[f].alias(f) for f in fields)))


def merged_value(right: Column, right_has: Column, left: Column) -> Column:
    """Value of a merged object: the right side's where it has the key, null included."""
    return F.when(right_has, right).otherwise(left)


def deny(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns but private ones; names that are not there are no error."""
    return df.drop(*columns)


def without_nul(c: Column, kind: T.DataType | None = None) -> Column:
    """Text without NUL characters, at any depth of arrays, maps and structs."""
    if kind is None or isinstance(kind, T.StringType):
        return F.replace(c, F.lit("\u0000"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: without_nul(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(without_nul(e["key"], kind.keyType).alias("key"), without_nul(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(without_nul(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def search(title: Column, channel: Column, text: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", title, channel)), F.lit(text.lower()))


def facets(checks: dict[str, Column | None]) -> Column:
    """Conjunction of the facets that are set."""
    out = F.lit(True)
    for c in checks.values():
        if c is not None:
            out = out & F.coalesce(c, F.lit(False))
    return out


def camera_available(live: Column, id_: Column, checked: Column, now: Column) -> Column:
    ok = live & id_.rlike("^[A-Za-z0-9_-]{11}$") & (checked > now - F.expr("interval 48 hours"))
    return F.coalesce(ok, F.lit(False))


def checked_argument(ok: Column, message: str, value: Column) -> Column:
    """``value``, or an error where the argument is not ok."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))
