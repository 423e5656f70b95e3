"""Queries over sources, page functions and single-record rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import places, scalar, text
from attesta.operators import filters, rollups, state
from attesta.session import scratch
from attesta.sources import archives, tables
from attesta.sources.tables import load
from attesta.streaming import streams

from .judgements import pick, strings
from .registry import query


@query(
    "page_walk",
    """
with w as (select cast(o_orderkey % 5 as varchar) as asked_batch, case when o_orderkey < 1500 then 0 else o_orderkey // 1000 end as page, o_orderkey as position,
 lpad(cast(case when o_orderkey % 97 = 0 then o_orderkey - 50 else o_orderkey end as varchar), 9, '0') as id, case when o_orderkey % 89 = 0 then null else cast(o_orderkey % 5 as varchar) end as batch_id from orders),
r as (select *, lag(id) over (partition by asked_batch order by page, position) as before, count(*) over (partition by asked_batch, page) as size from w)
select asked_batch, page, id, concat_ws(';', case when before >= id then 'not increasing' end, case when batch_id is distinct from asked_batch then 'wrong batch' end, case when size > 200 then 'page too long' end) as faults
from r where before >= id or batch_id is distinct from asked_batch or size > 200
""",
)
def page_walk(spark, sf_dir):
    k = F.col("o_orderkey")
    batch = (k % 5).cast("string")
    walk = load(spark, sf_dir, "orders").select(
        batch.alias("asked_batch"),
        F.when(k < 1500, 0).otherwise(F.floor(k / 1000)).alias("page"),
        k.alias("position"),
        F.lpad(F.when(k % 97 == 0, k - 50).otherwise(k).cast("string"), 9, "0").alias("id"),
        F.when(k % 89 != 0, batch).alias("batch_id"),
    )
    return tables.page_walk_faults(walk).select("asked_batch", "page", "id", F.array_join("faults", ";").alias("faults"))


@query("snapshot_check", "select 'missing table ' || n as fault from (values ('click'), ('absent'), ('view')) v(n) where n not in (select event_type from events) union all select 'snapshot too old' where (select max(ts) from events) is not null")
def snapshot_check(spark, sf_dir):
    held = load(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    at = lambda s: F.lit(s).cast("timestamp")
    return tables.snapshot_faults(held, ["click", "absent", "view"], at("2026-01-01 00:00:00"), at("2026-01-02 00:00:01"))


@query("snapshot_read", "select user_id, count(*) as n from events where event_type = 'view' group by user_id")
def snapshot_read(spark, sf_dir):
    """A batch read once stays as it was when its table is written anew."""
    path = scratch(spark, "table")
    ev = load(spark, sf_dir, "events").select(F.col("event_type").alias("batch_id"), "user_id")
    ev.write.parquet(path)
    cache = tables.ReadCache(lambda _: spark.read.schema(ev.schema).parquet(path))
    cache.get(spark, "events", "view")
    ev.where("user_id < 0").write.mode("overwrite").parquet(path)
    return cache.get(spark, "events", "view").groupBy("user_id").agg(F.count("*").alias("n"))


@query("chunked_lookup", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select user_id from events)")
def chunked_lookup(spark, sf_dir):
    asked = load(spark, sf_dir, "events").select(F.col("user_id").alias("l_orderkey"))
    return tables.looked_up(load(spark, sf_dir, "lineitem"), asked, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("file_sources", "select f as form, n_nationkey, n_name from nation, (values ('config'), ('csv'), ('jsonl')) v(f) union all select 'export', r_regionkey, r_name from region")
def file_sources(spark, sf_dir):
    """JSON configuration, JSON lines and CSV files, written and read back, and a JSON export."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = {form: scratch(spark, form) for form in ("config", "csv", "jsonl", "export")}
    whole = n.agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))).alias("value"))
    whole.write.text(path["config"])
    n.write.json(path["jsonl"])
    n.write.option("header", True).csv(path["csv"])
    tables.write_json_export(load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path["export"])
    read = {
        "config": tables.read_json_config(spark, path["config"]).select(F.explode("nations").alias("x")).select("x.*"),
        "csv": tables.read_csv_audit(spark, path["csv"]),
        "jsonl": tables.read_jsonl(spark, path["jsonl"], "n_nationkey int, n_name string"),
        "export": tables.read_jsonl(spark, path["export"]),
    }
    parts = [df.select(F.lit(form).alias("form"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name") for form, df in read.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("chunked_write", "select event_id, user_id from events")
def chunked_write(spark, sf_dir):
    """Micro-batches that each add only new ids; the target is whole when the stream has ended."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = streams.file_stream(spark, f"{sf_dir}/events.parquet*", raw).select("event_id", "user_id")
    target = scratch(spark, "target")
    streams.insert_batches(rows, target, "event_id", scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{target}/run-*")


@query(
    "active_rows",
    "select c_custkey, length(c_name) as n, c_name || '1' as note, c_name || '2' as tag from customer where c_custkey % 4 <> 0",
)
def active_rows(spark, sf_dir):
    """Rows that were not purged, without NUL characters at any depth."""
    nul = F.lit("\0")
    kind = T.StructType([T.StructField("note", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    c = load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat("c_name", nul).alias("c_name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("2026-01-01").cast("timestamp")).alias("purged_at"),
        F.struct(F.concat(nul, "c_name", F.lit("1")).alias("note"), F.array(F.concat("c_name", nul, F.lit("2"))).alias("tags")).alias("extra"),
    )
    extra = filters.without_nul(F.col("extra"), kind)
    return tables.active(c).select("c_custkey", F.length(filters.without_nul(F.col("c_name"))).alias("n"), extra["note"].alias("note"), extra["tags"][0].alias("tag"))


@query("deny_list", "select c_custkey, c_name, c_nationkey from customer")
def deny_list(spark, sf_dir):
    return filters.deny(load(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment", "not_there"])


@query("checked_arguments", "select event_id, user_id % 30 + 1 as days from events")
def checked_arguments(spark, sf_dir):
    days = F.col("user_id") % 30 + 1
    return load(spark, sf_dir, "events").select("event_id", filters.checked_argument(days.between(1, 30), "days must be from 1 to 30", days).alias("days"))


@query(
    "feed_reading",
    """
select c_nationkey as source, row_number() over (partition by c_nationkey order by c_custkey) - 1 as position, c_name || ' &' as title, 'https://x.eu/' || c_custkey as link,
 case when c_nationkey % 2 = 0 then 'Mon, 05 Jan 2026 10:00:00 GMT' else '2026-01-05T10:00:00Z' end as published, 'about ' || c_mktsegment as text from customer where c_custkey % 9 <> 0
""",
)
def feed_reading(spark, sf_dir):
    """RSS items and Atom entries of one feed a nation; entries without a link go."""
    c, k = load(spark, sf_dir, "customer").where("c_custkey % 9 <> 0"), F.col("c_custkey").cast("string")
    title = F.concat("c_name", F.lit(" &amp;amp; &amp;lt;Co&amp;gt;"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://x.eu/"), k, F.lit("</link><dc:date>old</dc:date><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><description><![CDATA[<p>about  "), "c_mktsegment", F.lit("</p>]]></description></item>"))
    atom = F.concat(F.lit("<a:entry><a:title>"), title, F.lit('</a:title><a:link href="https://x.eu/'), k, F.lit('"/><a:updated>2026-01-05T10:00:00Z</a:updated><a:summary>about '), "c_mktsegment", F.lit("</a:summary></a:entry>"))
    entry = F.when(F.col("c_nationkey") % 2 == 0, rss).otherwise(atom)
    bodies = c.groupBy(F.col("c_nationkey").alias("source")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("all"))
    bodies = bodies.select("source", F.concat(F.lit("<feed>"), F.array_join(F.transform("all", lambda x: x["e"]), "\n"), F.lit("<item><title>no link</title></item></feed>")).alias("body"))
    return tables.feed_entries(bodies)


@query("html_blocks", "select n_nationkey, n_name || ' of ' || n_regionkey as block, 'id ' || n_name as by_id from nation")
def html_blocks(spark, sf_dir):
    html = F.concat(F.lit('<body><img class="x"><div class="wide lead"><p>'), "n_name", F.lit(" of<br></p><script>no()</script><nav>menu</nav><div>"), F.col("n_regionkey").cast("string"), F.lit('</div></div><p id="own">id '), "n_name", F.lit('</p><p class="lead">second</p></body>'))
    n = load(spark, sf_dir, "nation").withColumn("html", html)
    return n.select("n_nationkey", text.block_text("html", F.lit("lead")).alias("block"), text.block_text("html", F.lit("own")).alias("by_id"))


def _cards(spark, sf_dir):
    """One archive page a nation: a dated card for each of its customers."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_sub(F.lit("2026-03-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd")
    url = F.concat(F.lit("https://x.eu/"), F.when(k % 50 == 7, k - 1).otherwise(k).cast("string"))
    card = F.concat(F.lit('<li class="item"><time datetime="'), day, F.lit('"></time><h3>'), "c_name", F.lit('</h3><a href="'), url, F.lit('">more</a></li>'))
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("e")))).alias("all"))
    return c.select(F.lit("s").alias("source"), "page", F.concat(F.lit("<ul>"), F.array_join(F.transform("all", lambda x: x["e"]), ""), F.lit("</ul>")).alias("body"))


CARDS = "select c_nationkey as page, c_custkey as k, c_name as title, 'https://x.eu/' || case when c_custkey % 50 = 7 then c_custkey - 1 else c_custkey end as url, date '2026-03-01' - cast(c_custkey % 90 as integer) as day from customer"


@query("card_reading", f"select page, row_number() over (partition by page order by k) - 1 as position, title, url, day from ({CARDS})")
def card_reading(spark, sf_dir):
    got = archives.entries(_cards(spark, sf_dir), archives.Contract("s"))
    return got.select("page", "position", "title", "url", scalar.local_day(F.col("published_at")).alias("day"))


@query("archive_discovery", f"select url, title, day from (select *, row_number() over (partition by url order by page, k) as nth from ({CARDS}) where day between date '2026-01-10' and date '2026-02-10') where nth = 1")
def archive_discovery(spark, sf_dir):
    """Entries inside a window of whole local days, one a url."""
    at = lambda s: F.lit(s).cast("timestamp")
    got = archives.discover(_cards(spark, sf_dir), archives.Contract("s", repeated="first"), at("2026-01-10 12:00:00"), at("2026-02-10 12:00:00"))
    return got.select("url", "title", scalar.local_day(F.col("published_at")).alias("day"))


@query(
    "archive_completeness",
    f"""
with c as ({CARDS}), o as (select *, lag(day) over (order by page, k) as before from c)
select fault from (values ('repeated url', (select count(*) > count(distinct url) from c)), ('order is not descending', (select bool_or(day > before) from o)), ('archive does not reach back', (select min(day) >= date '2025-11-01' from c)), ('total not reached', true)) v(fault, broken) where broken
""",
)
def archive_completeness(spark, sf_dir):
    totals = spark.createDataFrame([("s", 0, -1)], "source string, page int, total int")
    return archives.archive_faults(_cards(spark, sf_dir), archives.Contract("s", descending=True), F.lit("2025-11-01").cast("timestamp"), totals)


RELEASES = "select o_custkey as number, case when o_orderkey % 3 = 0 then 'en' else 'fr' end as language, o_orderkey as url, o_orderdate::date as released from orders"


def _releases(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), F.when(F.col("o_orderkey") % 3 == 0, "en").otherwise("fr").alias("language"), F.col("o_orderkey").alias("url"), F.to_date("o_orderdate").alias("released"))


@query("bilingual_once", f"with r as ({RELEASES}) select url from r where language = 'en' or released not in (select released from r where language = 'en')")
def bilingual_once(spark, sf_dir):
    return archives.bilingual_once(_releases(spark, sf_dir), "language", "released").select("url")


@query(
    "preferred_language",
    f"""
with r as ({RELEASES}), c as (select number, bool_or(n > 1) as conflict from (select number, language, count(distinct url) as n from r group by 1, 2) group by 1)
select number, url, conflict from (select *, row_number() over (partition by number order by language <> 'en', url) as nth from r) join c using (number) where nth = 1
""",
)
def preferred_language(spark, sf_dir):
    return archives.preferred_language(_releases(spark, sf_dir), "number", "language", "url").select("number", "url", "conflict")


@query("reconciled_dates", "select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'b' else 'a' end as issued, o_orderkey % 3 = 0 and o_orderkey % 2 <> 0 as conflict from orders")
def reconciled_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    date, conflict = archives.reconciled_date(F.lit("a"), F.when(k % 3 == 0, "b").when(k % 3 == 1, "a"), F.when(k % 2 == 0, True))
    return load(spark, sf_dir, "orders").select("o_orderkey", date.alias("issued"), conflict.alias("conflict"))


@query("daily_dispatch", "select event_id, hour(ts + interval 1 hour) = 15 and minute(ts) < 5 and user_id % 3 <> 0 as due from events")
def daily_dispatch(spark, sf_dir):
    """Due in the first five minutes after 15:00 in Amsterdam, unless run that day."""
    local = F.from_utc_timestamp("ts", "Europe/Amsterdam")
    return load(spark, sf_dir, "events").select("event_id", state.due_today(local, F.when(F.col("user_id") % 3 == 0, F.to_date(local))).alias("due"))


@query(
    "reconciled_findings",
    """
with f as (select doc_id, case when doc_id % 11 = 0 then 'source_unverified' else 'open' end as status, list_filter(['title', case when doc_id % 2 = 0 then 'date' end, case when doc_id % 3 = 0 then 'text' end], lambda x: x is not null) as issues from documents),
j as (select f.*, l.quality, l.doc_id is null or status = 'source_unverified' as as_is from f left join labels l using (doc_id))
select doc_id, array_to_string(case when as_is then issues else kept end, ',') as issues from (select *, list_filter(issues, lambda x: x = 'text' or (x = 'date' and quality = 1)) as kept from j) where as_is or len(kept) > 0
""",
)
def reconciled_findings(spark, sf_dir):
    i = F.col("doc_id")
    issues = F.array_compact(F.array(F.lit("title"), F.when(i % 2 == 0, "date"), F.when(i % 3 == 0, "text")))
    f = load(spark, sf_dir, "documents").select("doc_id", F.when(i % 11 == 0, "source_unverified").otherwise("open").alias("status"), issues.alias("issues"))
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    got = state.reconciled_findings(f, labels, "doc_id", lambda x: (x == "text") | ((x == "date") & F.coalesce(F.col("quality") == 1, F.lit(False))))
    return got.select("doc_id", F.array_join("issues", ",").alias("issues"))


@query(
    "bound_overrides",
    "select doc_id, case when doc_id % 2 = 0 and doc_id % 5 <> 0 and doc_id % 50 between 1 and 45 then trim(repeat('w ', cast(doc_id % 50 as integer))) else 'own' end as summary from documents",
)
def bound_overrides(spark, sf_dir):
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), i.cast("string")).alias("link"), F.coalesce("text", F.lit("")).alias("body"), F.lit("own").alias("summary"))
    o = d.where("doc_id % 2 = 0").select("doc_id", F.col("link").alias("url"), F.sha2(F.when(i % 5 == 0, "changed").otherwise(F.col("body")), 256).alias("text_hash"), F.trim(F.repeat(F.lit("w "), (i % 50).cast("int"))).alias("summary"))
    return state.bound_override(d, o, "doc_id", "link", "body", "summary").select("doc_id", "summary")


@query("batch_header", "select '1-URGENT' as batch_id, sha256('1-URGENT') as config_hash union all select 'new', 'fresh'")
def batch_header(spark, sf_dir):
    """A stored batch with the same configuration, and a new one."""
    held = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch_id")).distinct().withColumn("config_hash", F.sha2("batch_id", 256))
    urgent = held.where("batch_id = '1-URGENT'").first()["config_hash"]
    return state.open_batch(held, "1-URGENT", urgent).union(state.open_batch(held, "new", "fresh"))


@query(
    "projection_migration",
    """
select p_partkey, case when p_size % 3 = 0 then 1 else 2 end as n, sha256('{"x":[' || case when p_size % 3 = 0 then '' else '{"category":"edit","status":"' || p_brand || '"},' end || '{"category":"sound","status":"s"}]}') as label_hash from part
""",
)
def projection_migration(spark, sf_dir):
    """One category is dropped and the label hashed anew."""
    one = lambda c, s: F.struct(F.lit(c).alias("category"), s.alias("status"))
    items = F.filter(F.array(one("sound", F.lit("s")), one("old", F.lit("x")), one("edit", F.col("p_brand"))), lambda x: (x["category"] != "edit") | (F.col("p_size") % 3 != 0))
    got = state.project_categories(load(spark, sf_dir, "part").withColumn("items", items), "items", "old")
    return got.select("p_partkey", F.size("items").alias("n"), "label_hash")


@query("upsert_accepted", "select count(*) as accepted from customer where c_custkey % 3 <> 0 and c_nationkey % 2 = 0")
def upsert_accepted(spark, sf_dir):
    url = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "https://x/").otherwise("http://x/"), "c_name")
    rows = load(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("id"), url.alias("url"), F.lit("NL").alias("country_code"))
    return state.accepted(rows, F.col("id").isNotNull() & F.col("url").startswith("https://") & F.col("country_code").rlike("^[A-Z]{2}$"))


@query(
    "canonical_digests",
    """
select n_nationkey, sha256('[' || n_nationkey || ',"' || n_name || '",null]') as digest, '{"a":' || case when n_nationkey % 2 = 0 then 'null' else '"' || n_name || '"' end || ',"b":' || n_regionkey || '}' as json from nation
""",
)
def canonical_digests(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    json = scalar.null_keeping_json(F.struct(F.when(F.col("n_nationkey") % 2 != 0, F.col("n_name")).alias("a"), F.col("n_regionkey").alias("b")))
    return n.select("n_nationkey", scalar.digest([F.col("n_nationkey"), F.col("n_name"), F.lit(None).cast("string")]).alias("digest"), json.alias("json"))


@query("flag_codes", "select c_custkey, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then c else c || ',NL' end as codes from (select c_custkey, upper(substr(c_mktsegment, 1, 2)) as c from customer)")
def flag_codes(spark, sf_dir):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    flag = F.translate(F.upper(F.substring("c_mktsegment", 1, 2)), letters, "".join(chr(0x1F1E6 + i) for i in range(26)))
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "none").when(k % 3 == 1, F.concat(F.lit("a "), flag)).otherwise(F.concat(flag, F.lit(" and \U0001f1f3\U0001f1f1")))
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(scalar.flag_countries(title), ",").alias("codes"))


#: Names of the countries that the resolver's query looks for.
NAMES = {"NL": ["netherlands", "dutch"], "FR": ["france"], "DE": ["germany"], "BE": ["belgium"], "GE": ["georgia"], "ME": ["montenegro"], "GB": ["britain", "english"]}
TITLES = ["Dutch vote #france", "Georgia vote in Atlanta", "no place #netherlands #france", "France, Germany, Belgium and Dutch talks", "", "Luís Montenegro fala", "Luís Montenegro in Montenegro", "An English lesson \U0001f1e7\U0001f1ea", "words #france #germany #dutch"]
PARAGRAPHS = ["", "Subscribe to my channel about Germany today\n\nGermany", "https://x.eu Germany is a country here\n\nThe talks in Belgium went on for hours", "#a #b #c Germany and some more words"]


@query(
    "country_facets",
    """
with x as (select p_partkey, p_partkey % 9 as t, p_partkey // 9 % 4 as d, p_partkey // 36 % 2 as s from part),
y as (select *, case t when 0 then 'NL' when 6 then 'ME' when 7 then 'BE' end as title, case when d = 2 then 'BE' end as told, case when s = 1 then 'FR' end as heard, case t when 2 then 'NL,FR' else '' end as tagged from x)
select p_partkey, case when t = 3 then '' else coalesce(title, told, heard, tagged) end as codes from y
""",
)
def country_facets(spark, sf_dir):
    k = F.col("p_partkey")
    spoken = F.when(F.floor(k / 36) % 2 == 1, F.concat(F.lit("we speak from France "), F.repeat(F.lit("on and "), F.lit(80)), F.lit(" Germany")))
    codes = places.country_facets(pick(TITLES, k), pick(PARAGRAPHS, F.floor(k / 9)), spoken, NAMES)
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"))


@query(
    "lenient_dates",
    "select event_id, case event_id % 4 when 0 then ts::date - interval 1 hour when 1 then date_trunc('second', ts) when 2 then date_trunc('second', ts) end as at from events",
)
def lenient_dates(spark, sf_dir):
    """Days are midnight in Amsterdam, which in January is an hour before UTC's."""
    forms = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("some day")]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", scalar.lenient_date(raw).alias("at"))


@query(
    "publication_dates",
    """
select o_orderkey, case o_orderkey % 7 when 4 then timestamp '2025-01-06' - interval 1 hour when 5 then null when 6 then null
 when 0 then timestamp '2026-02-03 10:00:00' when 1 then timestamp '2026-01-04' - interval 1 hour when 2 then timestamp '2026-01-05 08:00:00' when 3 then timestamp '2026-01-05 10:00:00' end as at from orders
""",
)
def publication_dates(spark, sf_dir):
    pages = [
        '<META content="2026-02-03T10:00:00Z" PROPERTY="article:published_time"><time datetime="2020-01-01">',
        "<meta name='pubdate' x=1 content='2026-01-04'>",
        '<meta name="date" content="soon"><script>{"datePublished" : "2026-01-05T08:00:00Z"}</script>',
        '<p>x</p><time class="a" datetime="Mon, 05 Jan 2026 10:00:00 GMT">',
        "<meta name='author' content='2026-01-04'>",
        "",
        "<p>2026-01-01</p>",
    ]
    urls = ["http://x/", "http://x/", "http://x/", "http://x/2020/01/01/", "http://x/2025/1/6/a?b", "http://x/9999/99/99/", "http://x/?/2026/01/06/"]
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.publication_date(pick(pages, k), pick(urls, k)).alias("at"))


@query("month_numbers", "select c_custkey, [1, 8, 12, 3, null][c_custkey % 5 + 1] as month from customer")
def month_numbers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", scalar.month_number(pick(["Januari", "AOÛT", "dezember", "Marzo", "nothing"], F.col("c_custkey"))).cast("int").alias("month"))


@query(
    "transport_urls",
    "select c_custkey, case c_custkey % 4 when 0 then 'https://a.eu/%C3%A4%20b/' || c_custkey || '?q=a+b%20c' when 1 then 'http://xn--bcher-kva.de:80/x' when 2 then 'https://b.eu/%41%3Cb%3E' end as url from customer",
)
def transport_urls(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit("https://a.eu/ä b/"), k, F.lit("?q=a+b%20c#frag")), F.lit("http://Bücher.de:80/x"), F.lit("https://b.eu/%41<b>"), F.lit("ftp:nothing")]
    return load(spark, sf_dir, "customer").select("c_custkey", scalar.encoded_url(F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("url"))


@query(
    "caption_cues",
    "select event_id, event_id % 6 in (1, 2, 4) as music, case when user_id % 3 = 0 then 'max' when user_id % 3 = 1 then 'std' end as thumbnail from events",
)
def caption_cues(spark, sf_dir):
    captions = ["", "[Music]", "la ♪ la", "music is nice", "we hear [singing loudly] now", "[applause]"]
    size = F.col("user_id") % 3
    urls = F.create_map(F.lit("default"), F.lit(""), F.lit("standard"), F.when(size < 2, "std").otherwise(""), F.lit("maxres"), F.when(size == 0, "max"))
    return load(spark, sf_dir, "events").select("event_id", scalar.music_cue(pick(captions, F.col("event_id"))).alias("music"), scalar.best_thumbnail(urls).alias("thumbnail"))


@query(
    "ai_copy_checks",
    """
select event_id, concat_ws(';', case when event_id % 2 = 0 and not (event_id % 3 = 0 and event_id % 5 = 0) then 'AI not named' end, case when user_id % 4 = 0 and event_id % 7 < 3 then 'source missing' end) as faults from events
""",
)
def ai_copy_checks(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    rationales = ["No full article was here", "The document was not provided", "a source as a file attached", "articles about sources", "The text is fine", None, ""]
    faults = text.ai_copy_faults(
        F.when(i % 2 == 0, strings("artificial_intelligence", "x")).otherwise(strings("x")),
        F.when(i % 3 == 0, "New AI rules").otherwise("New MAIL rules"),
        F.when(i % 5 == 0, "Machine Learning law").otherwise("law"),
        pick(rationales, i),
        F.when(u % 4 < 2, "unclear").otherwise("related"),
        F.when(u % 4 == 0, 0.05).otherwise(0.9),
    )
    return load(spark, sf_dir, "events").select("event_id", F.array_join(faults, ";").alias("faults"))


@query(
    "quote_locator",
    r"""
with x as (select doc_id, coalesce(text, '') as t, substr(coalesce(text, ''), 5, 12) as q from documents)
select doc_id, case when q = '' then 'transcript' when contains(t, q) then 'transcript' end as section,
 len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}]+')), list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')))) as shared from x
""",
)
def quote_locator(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    one = lambda name, value: F.struct(F.lit(name).alias("id"), value.alias("text"))
    sections = F.array(one("title", F.substring(t, 1, 30)), one("transcript", t))
    quote = F.substring(t, 5, 12)
    return load(spark, sf_dir, "documents").select("doc_id", text.locate_quote(quote, sections).alias("section"), text.token_overlap(quote, t).alias("shared"))


def _public(spark, sf_dir):
    """Videos, inventory, totals and weeks made of the events by user."""
    ev = load(spark, sf_dir, "events")
    each = ev.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 20)).alias("both"), F.count_if(F.col("value") > 20).alias("high"))
    long = lambda c: c.cast("bigint")
    pair = lambda *kv: F.create_map(*(long(x) if i % 2 else F.lit(x) for i, x in enumerate(kv)))
    t, v, b, h = (F.col(c) for c in ("total", "views", "both", "high"))
    batch = F.concat(F.lit("2026-W0"), (F.col("user_id") % 5 + 1).cast("string"))
    labelled = F.col("user_id") % 7 != 0
    videos = each.select(
        batch.alias("batch"),
        F.col("user_id").cast("string").alias("id"),
        labelled.alias("labelled"),
        (F.col("user_id") % 2 == 0).alias("related"),
        "total",
        F.when(F.col("user_id") == 3, t + 1).otherwise(t - v).alias("human_reviewed"),
        t.alias("classified_comments"),
        (t + 1).alias("retained_comments"),
        pair("view", v, "other", t - v).alias("alignment"),
        pair("high", h, "low", t - h).alias("sentiment"),
        F.when(F.col("user_id") % 3 == 0, pair("view/high", b, "view/low", v - b, "other/high", h - b, "other/low", t - v - h + b)).alias("joint"),
    )
    inventory = videos.select("batch", "id", F.when(F.col("id").cast("int") % 10 == 0, "blocked").otherwise("saved").alias("caption"))
    n = F.count("*")
    collection = videos.agg(n.alias("sampled_videos"), n.alias("transcript_eligible"), F.count_if("labelled").alias("classified_videos"), F.lit(0).alias("awaiting_transcript"), n.alias("caption_total"), F.sum("total").alias("classified_comments"), F.lit(0).alias("reviewed_comments"), F.sum("retained_comments").alias("retained_comments"))
    history = videos.groupBy(F.col("batch").alias("id")).agg(n.alias("sampled"), F.count_if("labelled").alias("classified"), F.count_if(F.col("labelled") & F.col("related")).alias("related"))
    return videos, inventory, collection, history


@query(
    "public_counts",
    """
with e as (select user_id, count(*) as total from events group by 1)
select * from (values ('video duplicates', true), ('inventory duplicates', true), ('sample size', true), ('English text coverage', true), ('classified videos', true), ('missing text', true), ('caption categories', true),
 ('comment total', true), ('reviewed comments', (select count(*) = 0 from e where user_id = 3)), ('per-video comment count', true), ('classified exceeds retained', true), ('comments without classified video', (select count(*) = 0 from e where user_id % 7 = 0)),
 ('alignment values', true), ('alignment sum', true), ('sentiment values', true), ('sentiment sum', true), ('joint total', true), ('joint alignment', true), ('joint sentiment', true),
 ('global comments', true), ('global reviewed comments', (select count(*) = 0 from events where event_type <> 'view')), ('global retained comments', true), ('duplicate history weeks', true), ('history count type', true), ('history count bounds', true),
 ('retained history classified count', true), ('retained history related count', true), ('history gap overlaps saved week', (select count(*) = 0 from e where user_id % 5 = 0))) v("check", passed)
""",
)
def public_counts(spark, sf_dir):
    videos, inventory, collection, history = _public(spark, sf_dir)
    return rollups.count_checks(videos, inventory, collection, history, spark.createDataFrame([("2026-W01",)], "id string"))


@query(
    "week_health",
    """
with e as (select distinct user_id from events where user_id % 5 = 2)
select '2026-W03' as batch, case when count(*) = 0 then 'sample missing' when count(*) filter (where user_id % 7 <> 0) = 0 then 'nothing classified' when count(*) filter (where user_id % 7 = 0 and user_id % 10 <> 0) > 0 then 'saved but unclassified' end as fault,
 count(*) as sampled, count(*) filter (where user_id % 7 <> 0) as classified, count(*) filter (where user_id % 7 = 0 and user_id % 10 <> 0) as open from e
""",
)
def week_health(spark, sf_dir):
    videos, inventory, _, history = _public(spark, sf_dir)
    return rollups.week_health(history, inventory, videos, F.lit("2026-01-20 10:00:00").cast("timestamp"))
