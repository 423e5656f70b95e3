"""Generator draws, numbering streams, table functions, providers and main texts."""

import datetime
import hashlib
import html.parser
import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import tables, text
from attesta.operators import ordered, providers, rollups, sampling
from attesta.session import scratch
from attesta.streaming import streams


@pytest.mark.parametrize("rows_per_range", [200_000, 50])
def test_generator_draws_are_those_of_the_generator(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(3)
    items = [(rng.choice(["a", "b", "b", "b", None]), i, 0) for i in rng.sample(range(10_000), 300)]
    quota = {"a": 500, "b": 20, None: 3}
    df = spark.createDataFrame([(s, i, quota[s]) for s, i, _ in items], "s string, id long, quota int").repartition(4)
    got = {(r.s, r.id): (r.selected, r.probability) for r in sampling.stratified_rng_sample(df, "s", "id", "quota", 9).collect()}
    want = {}
    for s, q in quota.items():
        ids = sorted(str(i) for t, i, _ in items if t == s)
        n = min(len(ids), q)
        seeded = hashlib.sha256(json.dumps([9, str(s)], separators=(",", ":")).encode()).hexdigest()
        picked = set(random.Random(seeded).sample(ids, n))
        want |= {(s, int(i)): (i in picked, n / len(ids)) for i in ids}
    assert got == want
    assert sampling.stratified_rng_sample(df.where("false"), "s", "id", "quota", 9).count() == 0


def test_numbers_go_on_and_a_repeated_batch_gives_the_same(spark, tmp_path):
    start, check, target = datetime.datetime(2026, 1, 1), scratch(spark, "numbers"), scratch(spark, "given")
    schema = "token string, at timestamp"
    parts = [[("b", 5), ("a", 7), ("b", 1), (None, 0)], [("a", 0), ("c", 3), ("d", 3)], [("d", 1), ("e", 0)]]
    for part in parts:
        spark.createDataFrame([(t, start + datetime.timedelta(seconds=s)) for t, s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema))
        streams.numbered_batches(stream, target, "token", "at", check).awaitTermination()
    given = lambda: {r.token: r.number for r in spark.read.schema("token string, number long").parquet(f"{target}/batch-*").collect()}
    assert given() == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5}
    # a new checkpoint repeats all batches over the same target
    streams.numbered_batches(streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), target, "token", "at", scratch(spark, "again")).awaitTermination()
    assert given() == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5}


def test_table_functions(spark):
    tables.register(spark)
    got = spark.sql("select * from page_links('<a href=\"/x\">x</a><link rel=a href=\"/f\">')").collect()
    assert [tuple(r) for r in got] == [(0, "/x"), (1, "/f")] and spark.sql("select * from page_links(null)").count() == 0
    assert [tuple(r) for r in spark.sql("select * from text_chunks('aaa bbb ccc', 7)").collect()] == [(0, "aaa"), (1, "bbb"), (2, "ccc")]
    card = "<li><time>{}</time><a href='{}'>{}</a></li>"
    spark.createDataFrame([(card.format("2026-01-02", "/a", "A") + card.format("2026-01-03", "/b", "B"),)], "h string").createOrReplaceTempView("card_pages")
    sql = r"select c.* from card_pages, lateral page_cards(h, r'<li>.*?</li>', r'<time>(.*?)<', r'>([^<]*)</a>', r'href=.(.*?).>') c"
    assert [tuple(r) for r in spark.sql(sql).collect()] == [(0, "2026-01-02", "A", "/a"), (1, "2026-01-03", "B", "/b")]
    spark.createDataFrame([("<li><time>2026</time></li>",)], "h string").createOrReplaceTempView("card_pages")
    with pytest.raises(Exception, match="incomplete card"):
        spark.sql(sql).collect()


def test_providers_are_checked(spark):
    items = spark.createDataFrame([(i, None if i == 4 else f"text {i}") for i in range(6)], "id long, body string")
    answers = lambda ids, texts: [(i, len(t)) for i, t in zip(ids, texts) if t and i != 1] + [(99, 1)] * (0 in ids) + [(2, 5)] * (2 in ids)
    got = providers.labelled(items.coalesce(1), "id", F.col("body"), providers.by_batches(answers, "id long, size int"), {"even": F.col("id") != 3})
    rows = {(r.id, r.status, tuple(r.errors)) for r in got.collect()}
    assert rows == {(0, "classified", ()), (1, "pending", ()), (2, "rejected", ("answered twice",)), (3, "rejected", ("even",)), (4, "pending", ()), (5, "classified", ()), (None, "unknown", ())}
    none = providers.labelled(items.where("false"), "id", F.col("body"), providers.by_rules("kind", "other", a="a"), {})
    assert none.count() == 0 and none.columns == ["id", "body", "kind", "errors", "status"]


def test_batches_with_faults(spark):
    inventory = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 20, True), (3, 30, False), (3, 31, True)], "batch int, id int, saved boolean")
    got = rollups.batch_health(spark.createDataFrame([(b,) for b in range(5)], "batch int"), inventory, spark.createDataFrame([(10,), (30,)], "id int"))
    assert {(r.batch, r.sampled, r.classified, r.saved, r.open, r.fault) for r in got.collect()} == {(0, 0, 0, 0, 0, "nothing sampled"), (1, 2, 1, 1, 0, None), (2, 1, 0, 1, 1, "nothing classified"), (3, 2, 1, 1, 1, "saved but unclassified"), (4, 0, 0, 0, 0, "nothing sampled")}


class _Main(html.parser.HTMLParser):
    """The text of the first main or article element, by counting open tags alone."""

    def __init__(self):
        super().__init__()
        self.open, self.dumb, self.said, self.over = [], 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "hr", "input"):
            self.said.append(" ") if self.open and not self.dumb else None
            return
        if self.open or (tag in ("main", "article") and not self.over):
            self.open.append(tag)
            self.dumb += tag in ("script", "style", "nav", "aside", "footer", "noscript")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.dumb -= last in ("script", "style", "nav", "aside", "footer", "noscript")
                if last == tag:
                    break
            self.over = not self.open

    def handle_data(self, data):
        if self.open and not self.dumb:
            self.said.append(data)


def test_main_texts_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.t for r in pages.select("page_id", text.main_text()("html").alias("t")).collect()}
    for r in pages.collect():
        plain = _Main()
        plain.feed(r.html or "")
        assert " ".join(" ".join(plain.said).split()) == " ".join((got[r.page_id] or "").split())
