"""Row rules that give error lists, and gates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """Messages of the rules that are broken; a null rule counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for m, c in rules.items())))


def within(c: Column, lo: float, hi: float) -> Column:
    """Broken unless the value is known and inside."""
    return ~F.coalesce(c.between(lo, hi), F.lit(False))


def not_one_of(c: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(c.isin(allowed), F.lit(False))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def not_exact_cover(ids: Column, expected: Column) -> Column:
    """Broken unless the ids are the expected ones, each once."""
    return ~((F.size(ids) == F.size(F.array_distinct(ids))) & (F.array_sort(ids) == F.array_sort(expected)))


def foreign_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object outside a closed schema, and missing ones."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, allowed))
    return (F.size(F.array_except(keys, want)) > 0) | (F.size(F.array_except(want, keys)) > 0)


#: Dimensions of framing, directions of treatment, alignments that take a side.
DIMENSIONS = ("othering", "aversion", "moralization")
DIRECTIONS = ["negative", "positive", "mixed", "unclear"]
TAKES_SIDE = ["supports", "opposes", "mixed"]
#: Reactions that say nothing about the main message.
BESIDE_MESSAGE = ["speaker", "presentation", "unrelated"]
LONGEST_QUOTE = 400


def _some(array: Column, test) -> Column:
    """Whether an element passes; unknown arrays and answers count as passing."""
    return F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True))


def _adverse(direction: Column) -> Column:
    return F.coalesce(direction.isin("negative", "mixed"), F.lit(False))


def classification_rules(narratives: list[str], countries: list[str], top: int = 4, scores: dict[str, Column] | None = None, targets: Column | None = None) -> dict[str, Column]:
    """Rules of a framing label on a scale of 0 to ``top``, 4 or 6.

    Unknown values break the rule of their field.  ``scores`` and ``targets``
    stand in for the columns of those names.
    """
    if top not in (4, 6):
        raise ValueError("the scale ends at 4 or 6")
    scores = scores or {d: F.col(d) for d in DIMENSIONS}
    targets = F.col("targets") if targets is None else targets
    framed = sum((F.coalesce(c, F.lit(0)) for c in scores.values()), F.lit(0)) > 0
    named = F.concat(F.array("primary_narrative"), "secondary_narratives")
    out = {f"{d} out of range": within(c, 0, top) for d, c in scores.items()}
    out |= {f"{c} out of range": within(F.col(c), 0, 1) for c in ("confidence", "narrative_confidence")}
    return out | {
        "direction unknown": not_one_of(F.col("direction"), DIRECTIONS),
        "positive but framed": F.col("direction").eqNullSafe("positive") & framed,
        "narrative unknown": _some(named, lambda n: ~n.isin(narratives)),
        "other unexplained": F.coalesce(F.array_contains(named, "other"), F.lit(False)) & (blank(F.col("other_narrative_label")) | blank(F.col("other_narrative_explanation"))),
        "target incomplete": _some(targets, lambda t: (t["target_type"] == "") | (t["target_name"] == "") | ~t["direction"].isin(DIRECTIONS)),
        "framed without adverse target": framed & ~F.coalesce(F.exists(targets, lambda t: _adverse(t["direction"])), F.lit(False)),
        "country unknown": _some(F.col("countries"), lambda c: ~c.isin(countries)),
        "rationale missing": F.col("short_rationale").isNull(),
    }


def section_text(sections: Column, name: Column) -> Column:
    """Text of the section of that id, empty where there is none."""
    return F.coalesce(F.try_element_at(F.filter(sections, lambda s: s["id"] == name), F.lit(-1))["text"], F.lit(""))


def located(quote: Column, name: Column, sections: Column, preferred: str | None = None) -> Column:
    """The section a quote stands in: the named one, else the preferred, else the first."""
    holding = F.transform(F.filter(sections, lambda s: F.contains(s["text"], quote)), lambda s: s["id"])
    other = F.try_element_at(holding, F.lit(1))
    if preferred is not None:
        other = F.when(F.array_contains(holding, preferred), preferred).otherwise(other)
    there = (quote == "") | F.contains(section_text(sections, name), quote)
    return F.when(there, name).otherwise(F.coalesce(other, name))


def with_located_quotes(evidence: Column, sections: Column) -> Column:
    """Evidence whose ``source_id`` names the section that holds the unchanged quote."""
    return F.transform(evidence, lambda e: e.withField("source_id", located(e["quote"], e["source_id"], sections, "transcript")))


def evidence_rules(narratives: list[str], countries: list[str]) -> dict[str, Column]:
    """Rules of a label with one piece of quoted evidence for each dimension.

    Labels without a score carry null dimensions, which are checked as zeros.  A
    label of othering alone may have targets of unclear treatment.
    """
    scored = F.col("assessment_status").eqNullSafe("scored")
    scores = {d: F.when(scored, F.col(d)).otherwise(0) for d in DIMENSIONS}
    alone = F.coalesce((scores["othering"] > 0) & (scores["aversion"] == 0) & (scores["moralization"] == 0), F.lit(False))
    eased = F.when(alone, F.transform("targets", lambda t: t.withField("direction", F.when(t["direction"] == "unclear", "negative").otherwise(t["direction"])))).otherwise(F.col("targets"))
    evidence, sections = with_located_quotes(F.col("dimension_evidence"), F.col("sections")), F.col("sections")
    fields = ("quote", "source_id", "target", "speaker", "explanation", "attribution")
    score = lambda e: F.coalesce(*(F.when(e["dimension"] == d, F.col(d)) for d in DIMENSIONS), F.lit(0))
    target = lambda e: F.try_element_at(F.filter("targets", lambda t: t["target_name"] == e["target"]), F.lit(-1))
    asserted = lambda e: F.coalesce(e["attribution"].isin("author_assertion", "speaker_assertion"), F.lit(False))
    no_quote = lambda e: (e["quote"] != "") & ((F.length(e["quote"]) > LONGEST_QUOTE) | ~F.contains(section_text(sections, e["source_id"]), e["quote"]))
    return {
        "status unknown": not_one_of(F.col("assessment_status"), ["scored", "insufficient_evidence", "out_of_scope"]),
        "relevance unknown": not_one_of(F.col("public_affairs_relevance"), ["in_scope", "out_of_scope", "unclear"]),
        "stance unknown": not_one_of(F.col("publisher_stance"), ["asserted", "reported_only", "rejected", "mixed", "unclear"]),
        "status and relevance disagree": F.col("assessment_status").eqNullSafe("out_of_scope") != F.col("public_affairs_relevance").eqNullSafe("out_of_scope"),
        "unscored but with scores": ~scored & F.coalesce(*DIMENSIONS).isNotNull(),
        **classification_rules(narratives, countries, 6, scores, eased),
        "not one piece for each dimension": ~F.coalesce(F.array_sort(F.transform("dimension_evidence", lambda e: e["dimension"])) == F.array(*map(F.lit, sorted(DIMENSIONS))), F.lit(False)),
        "evidence incomplete": _some(F.col("dimension_evidence"), lambda e: F.greatest(*(e[f].isNull() for f in fields))),
        "explanation missing": _some(F.col("dimension_evidence"), lambda e: blank(e["explanation"])),
        "quote not in source": _some(evidence, no_quote),
        "score without evidence": _some(evidence, lambda e: (score(e) > 0) & ((e["quote"] == "") | target(e).isNull() | blank(e["speaker"]) | ~asserted(e))),
        "score without adverse target": _some(evidence, lambda e: (score(e) > 0) & (e["dimension"] != "othering") & target(e).isNotNull() & ~_adverse(target(e)["direction"])),
        "positive target scored": _some(evidence, lambda e: (score(e) > 0) & target(e)["direction"].eqNullSafe("positive")),
    }


def source_screen_rules() -> dict[str, Column]:
    """Rules of the decision whether a source can be assessed at all."""
    quote = F.col("evidence_quote")
    inside = F.exists("sections", lambda s: F.contains(s["text"], quote))
    return {
        "status unknown": not_one_of(F.col("assessment_status"), ["scored", "insufficient_evidence", "out_of_scope"]),
        "explanation missing": blank(F.col("explanation")),
        "quote unusable": quote.isNull() | (F.length(quote) > LONGEST_QUOTE),
        "quote not in source": (F.coalesce(quote, F.lit("")) != "") & ~F.coalesce(inside, F.lit(False)),
        "scored without quote": F.col("assessment_status").eqNullSafe("scored") & (F.coalesce(quote, F.lit("")) == ""),
        "confidence out of range": within(F.col("confidence"), 0, 1),
    }


def comment_target_rules(known: list[str] | None = None) -> dict[str, Column]:
    """Rules of a comment's stance: viewpoints, focus, rationale and target."""
    ids = F.col("viewpoint_ids")
    odd = _some(ids, lambda v: (v == "") | (~v.isin(known) if known else F.lit(False)))
    side = F.coalesce(F.col("alignment").isin(TAKES_SIDE), F.lit(False))
    return {
        "viewpoint ids faulty": odd | (F.size(F.array_distinct(ids)) != F.size(ids)),
        "stance beside the message": side & F.coalesce(F.col("response_focus").isin(BESIDE_MESSAGE), F.lit(False)),
        "rationale missing": blank(F.col("rationale")),
        "stance without target": side & blank(F.col("stance_target")),
        "stance without viewpoint": side & (F.coalesce(F.size(ids), F.lit(0)) <= 0),
    }


def label_rules(topics: list[str], roles: list[str]) -> dict[str, Column]:
    """Rules of a topic and role label; unrelated labels carry neither."""
    none = F.array().cast("array<string>")
    related = F.col("relevance") == "related"
    own_topics, own_roles = F.coalesce("topics", none), F.coalesce("roles", none)
    return {
        "relevance unknown": not_one_of(F.col("relevance"), ["related", "unrelated", "unclear"]),
        "topic unknown": F.size(F.array_except(own_topics, F.array(*map(F.lit, topics)))) > 0,
        "topic repeated": F.size(own_topics) != F.size(F.array_distinct(own_topics)),
        "role unknown": F.size(F.array_except(own_roles, F.array(*map(F.lit, roles)))) > 0,
        "unrelated but labelled": ~F.coalesce(related, F.lit(False)) & (F.size(F.concat(own_topics, own_roles)) > 0),
        "related without topic": F.coalesce(related, F.lit(False)) & (F.size(own_topics) == 0),
        "quote not in source": F.col("quote").isNotNull() & ~F.coalesce(F.contains(F.col("source_text"), F.col("quote")), F.lit(False)),
    }


def decision_rules(expected: Column, human: Column, decisions: Column) -> dict[str, Column]:
    """Rules of field decisions: one for each field, agreeing ones unchanged.

    The three are maps by field; values are canonical text.
    """
    keys = lambda m: F.array_sort(F.map_keys(m))
    each = F.map_entries(decisions)
    return {
        "decision missing": ~F.coalesce((keys(human) == keys(expected)) & (keys(decisions) == keys(expected)), F.lit(False)),
        "decision unknown": _some(each, lambda d: ~d["value"].isin("agree", "disagree")),
        "agreed but changed": _some(each, lambda d: (d["value"] == "agree") & ~F.try_element_at(human, d["key"]).eqNullSafe(F.try_element_at(expected, d["key"]))),
    }


def review_rules(versions: list[str]) -> dict[str, Column]:
    """Rules of any review: version and hash of its source, reviewer, stamp, basis."""
    return {
        "version or hash differs": not_one_of(F.col("source_version"), versions) | ~F.coalesce((F.col("version") == F.col("source_version")) & (F.col("queue_hash") == F.col("payload_hash")), F.lit(False)),
        "reviewer missing": blank(F.col("reviewer")),
        "stamp missing": F.coalesce("reviewed_at", F.lit("")) == "",
        "basis unknown": not_one_of(F.col("basis"), ["english_transcript", "watched_video"]),
        **decision_rules(F.col("expected"), F.col("human"), F.col("decisions")),
    }


def comment_review_rules(alignments: list[str], focuses: list[str], sentiments: list[str], known: list[str] | None = None) -> dict[str, Column]:
    """Rules of a reviewed comment label, beside those of any review."""
    labels = [not_one_of(F.col("alignment"), alignments), not_one_of(F.col("response_focus"), focuses), not_one_of(F.col("sentiment"), sentiments)]
    rules = comment_target_rules(known)
    rules.pop("rationale missing")
    if known is None:
        rules = {m: c for m, c in rules.items() if "viewpoint" not in m}
    return {"comment label unknown": F.greatest(*labels, F.col("sentiment_target").isNull(), F.col("stance_target").isNull()), **rules}


def video_review_rules(topics: list[str], roles: list[str], entities: list[str], statuses: list[str], structures: list[str], sentiments: list[str]) -> dict[str, Column]:
    """Rules of a reviewed video label: viewpoints, relevance, topics, roles, execution."""
    related = F.col("relevance").eqNullSafe("related")
    views = F.col("viewpoints")
    ids = F.transform(views, lambda v: v["viewpoint_id"])
    parts = ("viewpoint_id", "speaker", "summary", "target")
    own_topics, own_roles, done = F.col("topics"), F.col("roles"), F.col("execution")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return {
        "structure unknown": not_one_of(F.col("viewpoint_structure"), structures) | views.isNull(),
        "viewpoints do not fit structure": (F.col("viewpoint_structure").eqNullSafe("single_viewpoint") & (size(views) != 1)) | (F.col("viewpoint_structure").eqNullSafe("multiple_viewpoints") & (size(views) < 2)),
        "viewpoint ids repeated": F.size(F.array_distinct(ids)) != F.size(ids),
        "viewpoint incomplete": _some(views, lambda v: F.greatest(*(blank(v[p]) for p in parts)) | ~v["speaker_sentiment"].isin(sentiments)),
        "relevance unknown": not_one_of(F.col("relevance"), ["related", "unrelated", "unclear"]),
        "topic unknown": _some(own_topics, lambda t: ~t.isin(topics)),
        "topic repeated": F.size(F.array_distinct(own_topics)) != F.size(own_topics),
        "unrelated but labelled": ~related & (size(own_topics) + size(own_roles) > 0),
        "related without topic": related & (size(own_topics) == 0),
        "role faulty": _some(own_roles, lambda r: ~r["role"].isin(roles) | ~r["entity_code"].isin(entities) | blank(r["entity"])),
        "execution unknown": _some(done, lambda e: ~e["status"].isin([*statuses, "absent_after_watching"])),
        "absence without watching": _some(done, lambda e: (e["status"] == "absent_after_watching") & ~F.col("basis").eqNullSafe("watched_video")),
    }


def assisted_review_rules(countries: list[str], narratives: list[str]) -> dict[str, Column]:
    """Rules of a confirmation of model labels field by field.

    ``model`` and ``human`` are maps of arrays; a single value is an array of
    one, and order does not count.
    """
    sort = lambda m, k: F.array_sort(F.try_element_at(m, k))
    model, human, decisions = F.col("model"), F.col("human"), F.map_entries("decisions")
    keys = lambda m: F.array_sort(F.map_keys(m))
    same = lambda d: sort(human, d["key"]).eqNullSafe(sort(model, d["key"]))
    own = lambda k: F.try_element_at(human, F.lit(k))
    none = lambda k, allowed: own(k).isNotNull() & _some(own(k), lambda v: ~v.isin(allowed))
    return {
        "hash differs": ~F.coalesce(F.col("queue_hash") == F.col("label_hash"), F.lit(False)),
        "method unknown": not_one_of(F.col("review_method"), ["ai_assisted_confirmation"]),
        "basis missing": (F.coalesce("evidence_scope", F.lit("")) != "") & not_one_of(F.col("review_evidence_basis"), ["metadata_only", "metadata_and_english_transcript", "watched_video"]),
        "decision missing": ~F.coalesce(keys(F.col("decisions")) == keys(model), F.lit(False)),
        "agreed but changed": _some(decisions, lambda d: (d["value"] == "agree") & ~same(d)),
        "disagreed but unchanged": _some(decisions, lambda d: (d["value"] == "disagree") & same(d)),
        "decision unknown": _some(decisions, lambda d: ~d["value"].isin("agree", "disagree")),
        "country unknown": none("countries", countries),
        "narrative unknown": none("narratives", narratives) | (own("narratives").isNotNull() & (F.size(own("narratives")) == 0)),
        "stamp without zone": F.try_to_timestamp("reviewed_at").isNull() | ~F.coalesce(F.col("reviewed_at").rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.lit(False)),
    }


def all_or_nothing(rows: DataFrame, rules: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, faults): no row is written while any is faulty."""
    checked = rows.withColumn("errors", errors(rules))
    faults = checked.where(F.size("errors") > 0).select(key, "errors")
    bad = faults.agg(F.count("*").alias("_bad"))
    return rows.crossJoin(F.broadcast(bad)).where("_bad = 0").drop("_bad"), faults


def gate(facts: DataFrame, least: dict[str, int], tiers: list[str]) -> DataFrame:
    """Whether one row of counts reaches every minimum and holds all tiers; with reasons."""
    rules = {f"fewer than {n} {c}": F.col(c) < n for c, n in least.items()}
    rules["tier missing"] = F.size(F.array_except(F.array(*map(F.lit, tiers)), "tiers")) > 0
    return facts.select(errors(rules).alias("missing")).withColumn("passed", F.size("missing") == 0)


def segment_verdict(p_silence: Column, logprob: Column, ratio: Column, text: Column, overlaps_speech: Column) -> Column:
    """silence, uncertain_speech, repetitive_speech, empty_speech or accept.

    Silence needs both detectors: a low-confidence segment that overlaps a
    speech region is uncertain speech, never dropped.
    """
    quiet = ~F.coalesce(overlaps_speech, F.lit(False)) & (p_silence > 0.6) & (logprob < -1.0)
    return F.when(quiet, "silence").when(logprob < -1.0, "uncertain_speech").when(ratio > 2.4, "repetitive_speech").when(blank(text), "empty_speech").otherwise("accept")


#: Fixed value: seconds of the longest audio.
LONGEST_AUDIO = 7_200


def transcript_verdict(speech: dict[str, Column], segments: Column, longest: float = LONGEST_AUDIO, slack: float = 0.25) -> Column:
    """Why a transcription is no evidence, or null where it is.

    ``speech`` has language, probability, task, output_language, duration,
    speech_seconds, complete, covered and discarded; ``segments`` is an array of
    (text, start, end) in order.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    sure = yes(speech["language"].rlike("^[a-z]{2,3}$") & (speech["language"] != "und") & speech["probability"].between(0.6, 1))
    english = yes((speech["task"] == "translate") & (speech["output_language"] == "en"))
    timed = yes((speech["duration"] > 0) & (speech["duration"] <= longest + 1))
    bad = lambda s: blank(s["text"]) | ~yes((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= speech["duration"] + slack))
    starts = F.transform(segments, lambda s: s["start"])
    words = F.regexp_extract_all(F.lower(F.array_join(F.transform(segments, lambda s: s["text"]), " ")), F.lit(r"(?U)\w+"), 0)
    dense = yes((speech["speech_seconds"] > 0) & (speech["speech_seconds"] <= speech["duration"]) & (F.size(words) >= speech["speech_seconds"] / 3))
    whole = yes(speech["complete"]) & yes(speech["covered"]) & yes(speech["discarded"] == 0) & dense
    return (
        F.when(~sure, "AudioLanguageUncertain")
        .when(~english, "AudioEnglishTranslationRequired")
        .when(~timed, "AudioInvalidSegments")
        .when(F.coalesce(F.size(segments), F.lit(0)) <= 0, "AudioNoUsableSpeech")
        .when(F.exists(segments, bad) | ~yes(F.array_sort(starts) == starts), "AudioInvalidSegments")
        .when((F.size(words) == 0) | ((F.size(words) >= 20) & (F.size(F.array_distinct(words)) < 10)), "AudioNoUsableSpeech")
        .when(~whole, "AudioIncompleteTranscript")
    )
