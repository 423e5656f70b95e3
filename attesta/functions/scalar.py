"""Scalar functions over dates, numbers, JSON and URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_week(at: Column) -> Column:
    """``yyyy-Www`` of the ISO week."""
    return F.concat(F.format_string("%04d", F.extract(F.lit("YEAROFWEEK"), at).cast("int")), F.lit("-W"), F.format_string("%02d", F.weekofyear(at)))


def week_window(at: Column, zone: str = "Europe/Amsterdam") -> tuple[Column, Column, Column]:
    """(start, end, week id) of the last whole Sunday-to-Sunday week before ``at``.

    Midnights are local, so weeks with a clock change have 167 or 169 hours;
    the id is that of the last second inside.
    """
    local = F.to_date(F.from_utc_timestamp(at, zone))
    sunday = F.date_sub(local, F.pmod(F.dayofweek(local) - 1, F.lit(7)))
    utc = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return utc(F.date_sub(sunday, 7)), utc(sunday), iso_week(F.date_sub(sunday, 1))


def per_thousand(x: Column, views: Column) -> Column:
    """Ratio per 1,000 views; null without views."""
    return x / F.nullif(views, F.lit(0)) * 1000


def age_hours(published: Column, captured: Column) -> Column:
    """Hours between, not below zero; null if either is unknown."""
    hours = (F.unix_timestamp(captured) - F.unix_timestamp(published)) / 3600
    return F.when(published.isNotNull() & captured.isNotNull(), F.greatest(F.lit(0.0), hours))


def counter(text: Column) -> Column:
    """A count from text; null for what is no whole number or is negative."""
    n = F.try_to_number(F.when(text.rlike("^[0-9]{1,18}$"), text), F.lit("9" * 18)).cast("bigint")
    return F.when(n >= 0, n)


def digest(parts: list[Column]) -> Column:
    """SHA-256 of the JSON array of scalars, each in the form of its own type."""
    inner = [_unwrapped(F.to_json(F.array(p))) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]")), 256)


def _unwrapped(json: Column) -> Column:
    return F.substring(json, F.lit(2), F.length(json) - 2)


def null_keeping_json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def short_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 20)


def primary_language(tag: Column) -> Column:
    return F.split(F.replace(F.lower(F.coalesce(tag, F.lit("und"))), F.lit("_"), F.lit("-")), "-")[0]


def flag_countries(text: Column) -> Column:
    """ISO codes of flag characters (pairs of regional indicators)."""
    pairs = F.regexp_extract_all(text, F.lit("[\\x{1F1E6}-\\x{1F1FF}]{2}"), 0)
    letter = lambda c: F.char(F.ascii(c) - 127397)
    return F.transform(pairs, lambda p: F.concat(letter(F.substring(p, 1, 1)), letter(F.substring(p, 2, 1))))


def lenient_date(text: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Dates (local midnight), ISO stamps and RFC 2822 stamps; else null."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), zone))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(text))
    rest = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    mail = F.when(rest.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), F.try_to_timestamp(F.regexp_replace(rest, "(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.coalesce(day, iso, mail)


#: Names of meta elements that hold a publication date.
DATE_NAMES = ("article:published_time", "datePublished", "pubdate", "date")


def publication_date(html: Column, url: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Instant of the first readable date: meta elements, JSON-LD, time elements,
    then a year/month/day path of the URL (local midnight)."""
    quote, value = r"[\"']", r"([^\"']+)"
    named = rf"\b(?:property|name)\s*=\s*{quote}(?:{'|'.join(DATE_NAMES)}){quote}"
    content = rf"\bcontent\s*=\s*{quote}{value}"
    patterns = (rf"<meta\b[^>]*?{named}[^>]*?{content}", rf"<meta\b[^>]*?{content}[^>]*?{named}", rf"{quote}datePublished{quote}\s*:\s*{quote}{value}", rf"<time\b[^>]*?\bdatetime\s*=\s*{quote}{value}")
    found = [lenient_date(F.regexp_extract(html, rf"(?i){p}", 1), zone) for p in patterns]
    part = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    day = [F.regexp_extract(part, r"/(20\d{2})/(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])(?:/|$)", n) for n in (1, 2, 3)]
    path = F.concat_ws("-", day[0], F.lpad(day[1], 2, "0"), F.lpad(day[2], 2, "0"))
    return F.coalesce(*found, lenient_date(path, zone))


#: Month names of the languages met, by number.
MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "januar": 1, "februar": 2, "märz": 3, "dezember": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def canonical_url(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """Without trailing slashes, aliases of hosts resolved."""
    out = F.regexp_replace(url, "/+$", "")
    for a, b in (aliases or {}).items():
        out = F.regexp_replace(out, rf"(?<=://){a.replace('.', chr(92) + '.')}(?=/|$)", b)
    return out


def encoded_path(url: Column) -> Column:
    """Percent-encodes what a URL's path and query may not hold; encoded parts stay.

    The fragment goes.  Hosts are left to ``encoded_url``.
    """
    head = F.regexp_extract(url, r"^[a-z]+://[^/?#]*", 0)
    rest = F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), "#.*$", "")
    kept = r"[A-Za-z0-9/%:@!$&'()*+,;=._~?-]"
    pieces = F.regexp_extract_all(rest, F.lit(rf"{kept}+|(?:(?!{kept})[\s\S])+"), 0)
    return F.concat(head, F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^{kept}"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))), ""))


@F.pandas_udf(T.StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """Hosts in their ASCII form (IDNA); null where there is none."""

    def one(host):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(one, na_action="ignore")


def encoded_url(url: Column) -> Column:
    """A URL for HTTP: ASCII host, encoded path and query; null without a host.

    Only hosts past ASCII leave the JVM's functions.
    """
    host = F.regexp_extract(url, r"^https?://([^/?#:@]+)(?::[0-9]+)?(?:[/?#]|$)", 1)
    plain = encoded_path(url)
    ascii_ = F.when(host.rlike("^[\\x00-\\x7F]+$"), host).otherwise(ascii_host(F.when(~host.rlike("^[\\x00-\\x7F]*$"), F.lower(host))))
    start = F.instr(plain, "://") + 3
    return F.when(host != "", F.concat(F.substring(plain, F.lit(1), start - 1), ascii_, F.substring(plain, start + F.length(host), F.length(plain))))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def effective_policy(at: Column, switches: list[tuple[str, str]], default: str) -> Column:
    """The last policy whose switch instant has come."""
    out = F.lit(default)
    for when, name in sorted(switches):
        out = F.when(at >= F.lit(when).cast("timestamp"), name).otherwise(out)
    return out


def local_day(at: Column, zone: str = "Europe/Amsterdam") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def topic_codes(topics: Column, primary: Column, secondary: Column) -> Column:
    """Topics, else primary and secondary; distinct and not empty."""
    both = F.concat(F.array(primary), F.coalesce(secondary, F.array().cast("array<string>")))
    picked = F.when(F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0, topics).otherwise(both)
    return F.array_distinct(F.filter(picked, lambda t: t.isNotNull() & (t != "")))


def error_category(status: Column, message: Column, kind: Column | None = None) -> Column:
    """Category of a failed fetch by HTTP status, the one in the message, or the
    kind of error: ``tls``, ``dns``, ``timeout``, ``closed`` or ``format``."""
    named = F.nullif(F.regexp_extract(message, r"\b(?:HTTP(?: Error)? |error: )([1-5]\d\d)\b", 1), F.lit("")).cast("int")
    status = F.coalesce(status, named)
    kind = F.coalesce(kind, F.lit("")) if kind is not None else F.lit("")
    return (
        F.when(status.isin(401, 403, 429), "possible_access_restriction")
        .when(status == 404, "source_url_changed_or_removed")
        .when(status >= 500, "possible_service_outage")
        .when(kind == "tls", "tls_validation_failure")
        .when(kind == "dns", "dns_failure")
        .when((kind == "timeout") | F.coalesce(F.lower(message).contains("timed out"), F.lit(False)), "timeout_or_network_path")
        .when(kind == "closed", "connection_closed")
        .when(kind == "format", "collector_or_page_format_changed")
        .otherwise("unclassified_failure")
    )


def nonlexical(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")


#: Fixed value: bracketed cues of music and note signs.
MUSIC = r"(?i)\[(?:music|instrumental|singing)[^\]]*\]|[♪♫]"


def music_cue(text: Column) -> Column:
    """Whether a caption marks music anywhere."""
    return F.coalesce(text.rlike(MUSIC), F.lit(False))


#: Thumbnail sizes, best first.
THUMBNAILS = ("maxres", "standard", "high", "medium", "default")


def best_thumbnail(urls: Column) -> Column:
    """First non-empty URL of a map by size."""
    return F.coalesce(*(F.nullif(F.try_element_at(urls, F.lit(n)), F.lit("")) for n in THUMBNAILS))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in units of the world's width."""
    y = F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))
    return (lon + 180) / 360, F.lit(0.5) - y / F.lit(6.283185307179586)


def marker_size(n: Column, top: float, largest: float = 1.0) -> Column:
    return F.sqrt(F.least(F.lit(1.0), n / top)) * largest
