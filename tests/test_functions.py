"""Text, date and source functions."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import places, scalar, text
from attesta.operators import filters
from attesta.sources import archives, tables


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_normalized_folds_case_and_forms(spark):
    df = spark.createDataFrame([("  Straße\n ﬁ ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalized("t")).collect()] == ["strasse fi", None]


def test_terms_stand_at_word_boundaries_of_any_script(spark):
    assert one(spark, text.has_term(F.lit("in Österreich."), "Österreich"), text.has_term(F.lit("Österreicher"), "Österreich")) == (True, False)


def test_flags(spark):
    assert one(spark, scalar.flag_countries(F.lit("🇳🇱 and 🇩🇪")))[0] == ["NL", "DE"]


@pytest.mark.parametrize("raw, want", [("2026-07-01", "2026-06-30 22:00:00"), ("2026-01-05T10:00:00Z", "2026-01-05 10:00:00"), ("Mon, 05 Jan 2026 10:00:00 GMT", "2026-01-05 10:00:00"), ("soon", None)])
def test_lenient_dates(spark, raw, want):
    assert one(spark, scalar.lenient_date(F.lit(raw)).cast("string"))[0] == want


def test_months_and_urls(spark):
    got = one(spark, scalar.month_number(F.lit("Août")), scalar.canonical_url(F.lit("https://a.eu/x//"), {"a.eu": "b.eu"}), scalar.encoded_path(F.lit("https://a.eu/ä b/c")), F.length(scalar.short_id(F.lit("x"))))
    assert got == (8, "https://b.eu/x", "https://a.eu/%C3%A4%20b/c", 20)


def test_publication_date_order(spark):
    html = '<meta property="article:published_time" content="2026-02-03T00:00"><time datetime="2020-01-01">'
    got = one(spark, scalar.publication_date(F.lit(html), F.lit("")), scalar.publication_date(F.lit(""), F.lit("http://x/2026/05/06/a")), scalar.publication_date(F.lit(""), F.lit("http://x/a")))
    day = lambda c: one(spark, scalar.local_day(F.lit(c)).cast("string"))[0]
    assert (day(got[0]), day(got[1]), got[2]) == ("2026-02-03", "2026-05-06", None)


def test_quote_repair(spark):
    df = spark.createDataFrame([("we will not yield", "He said: We will, NOT yield!"), ("exact", "an exact one"), ("two words", "Two, words"), ("absent words here", "nothing")], "q string, s string")
    assert [r[0] for r in df.select(text.repaired_quote("q", "s")).collect()] == ["We will, NOT yield", "exact", None, None]


def test_html_blocks(spark):
    html = '<div><main>Hi <b>there</b><script>x()</script><nav>menu</nav> you<br>all</main><p class="lead big">Lead</p></div>'
    df = spark.createDataFrame([(html, "lead"), (None, "lead")], "h string, c string")
    assert [r[0] for r in df.select(text.main_text()("h")).collect()] == ["Hi there you all", None]
    assert [r[0] for r in df.select(text.block_text("h", "c")).collect()] == ["Lead", ""]


def test_chunks_cut_at_blanks(spark):
    df = spark.createDataFrame([("aaa bbb ccc",), ("abcdefgh",), ("",)], "t string")
    assert [r[0] for r in df.select(text.chunks("t", F.lit(7))).collect()] == [["aaa", "bbb", "ccc"], ["abcdefg", "h"], []]


def test_incomplete_cards_raise(spark):
    pattern = dict(item=r"(?s)<li>.*?</li>", date=r"<time>(.*?)</time>", title=r"<b>(.*?)</b>", link=r'href="(.*?)"')
    good, bad = '<li><time>2026-01-01</time><b>T</b><a href="u"></a></li>', "<li><b>T</b></li>"
    assert one(spark, text.cards(F.lit(good), **pattern))[0][0].title == "T"
    with pytest.raises(Exception, match="incomplete card"):
        spark.createDataFrame([(bad,)], "h string").select(text.cards(F.col("h"), **pattern)).collect()


def test_country_resolver(spark):
    names = {"GE": ["georgia"], "NL": ["netherlands", "dutch"], "FR": ["france"], "DE": ["germany"], "BE": ["belgium"], "ME": ["montenegro"]}
    resolve = lambda *a: one(spark, places.country_facets(*[F.lit(x) for x in a], names))[0]
    assert resolve("Dutch vote", "France is in this paragraph too", "") == ["NL"]
    assert resolve("", "Subscribe now for more about Belgium\n\nFrance and Germany met here today", "") == ["FR", "DE"]
    assert resolve("Dutch France Germany Belgium", "France is in this paragraph too", "") == []
    assert resolve("Georgia vote in Atlanta", "", "") == [] and resolve("Georgia vote in Tbilisi and Atlanta", "", "") == ["GE"]
    assert resolve("Luis Montenegro speaks", "", "we go to France") == ["FR"] and resolve("Luis Montenegro in Montenegro", "", "") == ["ME"]
    assert resolve("words #france #germany #dutch", None, None) == [] and resolve("words #france", None, None) == ["FR"]


def test_feeds_and_archives(spark):
    rss = "<rss><item><title>A</title><link>https://x/a</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>B</title><link>https://x/b</link><dc:date>2025-12-01</dc:date></item></rss>"
    atom = '<feed><entry><title>C</title><link href="https://x/c"/><updated>2026-01-06T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("rss", 0, rss), ("atom", 0, atom)], "source string, page int, body string")
    got = {(r.source, r.title, r.link) for r in tables.feed_entries(df).collect()}
    assert got == {("rss", "A", "https://x/a"), ("rss", "B", "https://x/b"), ("atom", "C", "https://x/c")}
    c = archives.Contract("rss", form="xml", descending=True)
    t = lambda s: F.lit(s).cast("timestamp")
    assert [r.title for r in archives.discover(df, c, t("2026-01-01"), t("2026-01-31")).collect()] == ["A"]
    assert archives.archive_faults(df, c, t("2026-01-01")).count() == 0
    assert [r.fault for r in archives.archive_faults(df, c, t("2025-01-01")).collect()] == ["archive does not reach back"]
    totals = spark.createDataFrame([("rss", 0, 3)], "source string, page int, total int")
    assert [r.fault for r in archives.archive_faults(df, c, t("2026-01-01"), totals).collect()] == ["total not reached"]


def test_release_languages(spark):
    df = spark.createDataFrame([("1", "en", "u", "t1"), ("1", "fr", "v", "t1"), ("2", "fr", "w", "t2")], "n string, lang string, url string, at string")
    assert {r.url for r in archives.bilingual_once(df, "lang", "at").collect()} == {"u", "w"}
    assert {(r.url, r.conflict) for r in archives.preferred_language(df, "n", "lang", "url").collect()} == {("u", False), ("w", False)}
    date, conflict = archives.reconciled_date(F.lit("a"), F.lit("b"), F.lit(True))
    assert one(spark, date, conflict) == ("b", False)


def test_custom_dates_hold_the_whole_last_day(spark):
    at = F.lit("2026-10-10 18:00:00").cast("timestamp")
    now = F.lit("2026-11-01").cast("timestamp")
    got = one(spark, filters.date_facet(at, "custom", now, "2026-10-10", "2026-10-10"), filters.date_facet(F.lit(None).cast("timestamp"), "day", now), filters.date_facet(F.lit(None).cast("timestamp"), "all", now))
    assert got == (True, False, True)


def test_key_exists_counts_null_values(spark):
    df = spark.createDataFrame([('{"a":null}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in df.select(filters.key_exists(F.col("p"), "a")).collect()] == [True, False, False]


def test_iso_week_retention(spark):
    today = F.lit("2026-10-20").cast("date")
    assert one(spark, filters.retained_week(F.lit("2026-W40"), today), filters.retained_week(F.lit("2026-W30"), today), filters.retained_week(F.lit("x"), today)) == (True, False, False)


def test_page_limits(spark):
    with pytest.raises(ValueError):
        tables.keyset_page(spark.range(3), None, 201)
    with pytest.raises(ValueError):
        tables.keyset_page(spark.range(3), None, True)
    walk = spark.createDataFrame([("b", 0, 0, "a", "b"), ("b", 0, 1, "c", "b"), ("b", 1, 0, "b", "x")], "asked_batch string, page int, position int, id string, batch_id string")
    assert {tuple(r.faults) for r in tables.page_walk_faults(walk).collect()} == {("not increasing", "wrong batch")}


def test_snapshot_faults(spark):
    held = spark.createDataFrame([("a",)], "name string")
    now = F.lit("2026-01-03").cast("timestamp")
    got = {r.fault for r in tables.snapshot_faults(held, ["a", "b"], F.lit("2026-01-01").cast("timestamp"), now).collect()}
    assert got == {"missing table b", "snapshot too old"}


def test_country_patterns_run_once_an_evidence(spark):
    df = spark.createDataFrame([("Dutch talks", "", None)], "t string, d string, s string")
    plan = df.select(places.country_facets(F.col("t"), F.col("d"), F.col("s"), {"NL": ["dutch"], "FR": ["france"]}))._jdf.queryExecution().analyzed().toString()
    assert plan.count("dutch\\E)(?!") <= 8
