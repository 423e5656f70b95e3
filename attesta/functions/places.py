"""Country facet resolver: what a source is about, by an ordered list of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import flag_countries

MOST = 3
#: Characters of the description, and words of the transcript, that are context.
CONTEXT_CHARS, TRANSCRIPT_WORDS = 1200, 120

#: Signs that Georgia is the American state, and that it is not.
STATE = r"\b(?:atlanta|ossoff|medicaid|six flags|dalton|north georgia|coffee county|chatham county|georgia national fair|us senate|u\.s\. senate|georgia state|hurricane isaias|mike collins|booking records|county jail|sheriff)\b"
CAUCASUS = r"\b(?:tbilisi|caucasus|abkhazia|ossetia)\b"
#: Signs that Montenegro is a person, and that it is the country.
PERSON = r"\b(?:lu[ií]s|luis|maxi|fernanda|comendador)\s+montenegro\b|\b(?:chega|andr[eé] ventura|sns|primeiro.ministro)\b"
TO_MONTENEGRO = r"\b(?:in|to|from|dans|en|em|nach|im|u|v)\s+montenegro\b"
ADRIATIC = r"\b(?:crna gora|adriatic|balkan)\b"
FLAG_ME = "\U0001f1f2\U0001f1ea"
#: Fixed value: how paragraphs of promotion begin.
PROMOTION = r"^(?:subscribe|follow|book a|join (?:me|our)|check out|visit my|watch more|tags:|keywords:)"


def held(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def cues(text: Column, countries: dict[str, list[str]]) -> Column:
    """Codes of the countries whose names stand in a text at word boundaries, in the order given."""
    found, every = [], []
    for code, names in countries.items():
        own = "|".join("\\Q" + n.lower() + "\\E" for n in names if not (code == "GB" and n.lower() == "english"))
        if own:
            found.append((code, rf"(?U)(?<!\w)(?:{own})(?!\w)"))
            every.append(own)
    none = F.array().cast("array<string>")
    if not found:
        return none
    # most texts name none of the countries: one pattern for all goes ahead of one for each
    anyone = rf"(?U)(?<!\w)(?:{'|'.join(every)})(?!\w)"
    each = lambda t: F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(code)) for code, p in found)))
    return held(plain(text), lambda t: F.when(t.rlike(anyone), each(t)).otherwise(none))


def focused(text: Column, countries: dict[str, list[str]], context: Column, title: Column, description: Column) -> Column:
    """Cues without Georgia the state and Montenegro the person, by context."""
    says = lambda c, p: c.rlike(f"(?U){p}")
    flag = F.contains(title, F.lit(FLAG_ME)) | F.contains(F.substring(description, 1, CONTEXT_CHARS), F.lit(FLAG_ME))

    def kept(found: Column) -> Column:
        # the context is asked only where one of the two is named
        state = F.when(F.array_contains(found, "GE"), says(context, STATE) & ~says(context, CAUCASUS)).otherwise(False)
        person = F.when(F.array_contains(found, "ME"), says(context, PERSON) & ~(flag | says(plain(title), TO_MONTENEGRO) | says(context, ADRIATIC))).otherwise(False)
        drop = F.array_compact(F.array(F.when(state, F.lit("GE")), F.when(person, F.lit("ME"))))
        return F.when(F.arrays_overlap(found, F.array(F.lit("GE"), F.lit("ME"))), held(drop, lambda d: F.filter(found, lambda c: ~F.array_contains(d, c)))).otherwise(found)

    return held(cues(text, countries), kept)


def substantive(paragraph: Column) -> Column:
    """Whether a paragraph is prose: no link or hashtag list, five words, no promotion."""
    body = F.trim(paragraph)
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    return ~body.rlike(r"^(?:https?://|#)") & (F.regexp_count(body, F.lit(r"(?U)#\w+")) < 3) & (words >= 5) & ~plain(body).rlike(PROMOTION)


def country_facets(title: Column, description: Column, transcript: Column, countries: dict[str, list[str]]) -> Column:
    """Codes of the first evidence that names countries, if it names at most three.

    Evidence is the title ahead of its hashtags with its flags, then each
    substantive paragraph, then the start of the transcript (text), then the
    title's hashtags, which count up to two countries only.
    """
    none = F.array().cast("array<string>")
    title, description, transcript = (F.coalesce(c, F.lit("")) for c in (title, description, transcript))
    before = plain(F.concat(title, F.lit("\n"), F.substring(description, 1, CONTEXT_CHARS)))
    start = F.array_join(F.slice(F.filter(F.split(transcript, r"(?U)\s+"), lambda w: w != ""), 1, TRANSCRIPT_WORDS), " ")
    few = lambda c: F.when(F.size(c) <= MOST, c).otherwise(none)

    def found(context: Column) -> Column:
        at = lambda text, around: focused(text, countries, around, title, description)
        flags = F.filter(flag_countries(title), lambda c: c.isin(list(countries)))
        named = F.array_distinct(F.concat(at(F.trim(F.split(title, "#")[0]), context), flags))
        paragraphs = F.transform(F.filter(F.split(description, r"\n\s*\n"), substantive), lambda p: at(p, context))
        told = F.coalesce(F.try_element_at(F.filter(paragraphs, lambda c: F.size(c) > 0), F.lit(1)), none)

        def late(spoken: Column) -> Column:
            heard = F.when(spoken != "", F.concat(context, F.lit("\n"), plain(spoken))).otherwise(context)
            tags = F.when(F.instr(title, "#") > 0, at(F.regexp_extract(title, r"(?s)#.*$", 0), heard)).otherwise(none)
            tagged = held(tags, lambda c: F.when(F.size(c) <= 2, c).otherwise(none))
            return held(at(spoken, heard), lambda said: F.when(F.size(said) > 0, few(said)).otherwise(tagged))

        # each piece of evidence once, and only where those before it name nothing
        last = held(told, lambda t: F.when(F.size(t) > 0, few(t)).otherwise(held(start, late)))
        return held(named, lambda n: F.when(F.size(n) > 0, few(n)).otherwise(last))

    return held(before, found)
