"""Vector, clustering and measure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.scalar import cosine
from attesta.operators import vectors
from attesta.sources.tables import load

from .registry import query

COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(
    "knn_top8",
    f"select vec_id as query, neighbour, cosine, rank from (select a.vec_id, b.vec_id as neighbour, round({COS}, 6) as cosine, row_number() over (partition by a.vec_id order by round({COS}, 12) desc, b.vec_id) as rank from embeddings a, embeddings b) where rank <= 8",
)
def knn_top8(spark, sf_dir):
    got = vectors.knn(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return got.withColumn("cosine", F.round("cosine", 6))


@query("cosine_pairs", f"select a.vec_id as a, b.vec_id as b, round({COS}, 6) as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where {COS} >= 0.35")
def cosine_pairs(spark, sf_dir):
    return vectors.similar_pairs(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).withColumn("cosine", F.round("cosine", 6))


@query(
    "centroid_similarity",
    """
with e as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), c as (select label, list(m order by i) as centroid from (select label, i, avg(v) as m from e group by 1, 2) group by label)
select a.vec_id, a.label, round(list_cosine_similarity(a.embedding::double[], c.centroid), 6) as similarity from embeddings a join c using (label)
""",
)
def centroid_similarity(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    c = vectors.centroid(e, ["label"], "embedding")
    return e.join(c, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


def clusters(by: str, least: float, smallest: int = 1) -> str:
    """Common tables of DuckDB for greedy complete-link clusters: k(g, cluster, vec_id)."""
    far = f"len(list_filter(m, lambda j: list_cosine_similarity(vs[i + 1], vs[j]) < {least})) = 0"
    return f"""
with recursive v as (select {by} as g, list(embedding::double[] order by vec_id) as vs, list(vec_id order by vec_id) as ids from embeddings group by 1),
c as (select g, 0 as i, []::bigint[][] as groups from v
 union all select g, i + 1, case when coalesce(pos, 0) = 0 then list_append(groups, [i + 1]) else list_concat(list_append(groups[1:pos - 1], list_append(groups[pos], i + 1)), groups[pos + 1:]) end
 from (select g, i, groups, list_position(list_transform(groups, lambda m: {far}), true) as pos from c join v using (g) where i < len(vs))),
l as (select g, ids, list_filter(groups, lambda m: len(m) >= {smallest}) as groups from c join v using (g) where i = len(vs)),
n as (select g, ids, groups, unnest(generate_series(1, len(groups))) as number from l),
k as (select g, number - 1 as cluster, ids[unnest(groups[number])] as vec_id from n)"""


@query("complete_link_clusters", clusters("label", 0.2, 2) + " select g as label, vec_id, cluster from k")
def complete_link_clusters(spark, sf_dir):
    return vectors.complete_link(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2, 2)


@query(
    "cluster_representatives",
    clusters("label", 0.25) + " select g as label, vec_id, cluster, min(vec_id) over (partition by g, cluster) as representative, case when vec_id = min(vec_id) over (partition by g, cluster) then 'direct' else 'propagated' end as provenance from k",
)
def cluster_representatives(spark, sf_dir):
    c = vectors.complete_link(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.25)
    return vectors.representatives(c, "label", "vec_id")


CENTROIDS = "m as (select g, cluster, list(x order by p) as centroid from (select g, cluster, p, avg(x) as x from (select g, cluster, generate_subscripts(embedding, 1) as p, unnest(embedding)::double as x from k join embeddings using (vec_id)) group by 1, 2, 3) group by 1, 2)"


@query(
    "narrative_injection",
    clusters("vec_id % 20", 0.05)
    + f""", {CENTROIDS}, s as (select vec_id % 20 as g, arg_min(embedding::double[], vec_id) as source, arg_min(label, vec_id) as own, count(*) as total from embeddings group by 1),
q as (select g, cluster, count(*) as n, bool_or(label = own) as shares from k join embeddings using (vec_id) join s using (g) group by 1, 2),
i as (select g, sum(n) as inside from q join m using (g, cluster) join s using (g) where n >= 3 and not shares and list_cosine_similarity(centroid, source) < 0.35 group by 1)
select s.g as video, round(coalesce(inside, 0) / total, 9) as injection from s left join i using (g)""",
)
def narrative_injection(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("video", F.col("vec_id") % 20).withColumn("narrative", F.concat(F.lit("n"), F.col("label").cast("string")))
    c = vectors.complete_link(e, "video", "vec_id", "embedding", 0.05)
    sources = e.groupBy("video").agg(F.min_by("embedding", "vec_id").alias("source_vector"), F.array(F.min_by("narrative", "vec_id")).alias("source_labels"))
    return vectors.injection(c, e, sources, "video", "vec_id", "embedding", "narrative").withColumn("injection", F.round("injection", 9))


@query(
    "recurrence_exact",
    """
with n as (select doc_id, source, lang, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as norm from documents)
select md5(norm) as h, count(*) as n, count(distinct source) as sources, count(distinct lang) as owners, min(doc_id) as first_seen, max(doc_id) as last_seen from n group by norm having count(distinct source) >= 2
""",
)
def recurrence_exact(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    norm = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))
    rows = d.withColumn("h", F.md5(norm.cast("binary")))
    got = rows.groupBy("h").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("owners"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"))
    return got.where("sources >= 2")


@query(
    "recurrence_clusters",
    f"""
with p as (select a.vec_id as q, b.vec_id as id, b.embedding::double[] as v, round({COS}, 12) as c, row_number() over (partition by a.vec_id order by round({COS}, 12) desc, b.vec_id) as nth from embeddings a, embeddings b),
near as (select list(id order by id) as ids, list(v) as vs from p where nth <= 8 and c >= 0.3 group by q),
mutual as (select ids from near where len(ids) > 1 and len(list_filter(vs, lambda x: len(list_filter(vs, lambda y: round(list_cosine_similarity(x, y), 12) < 0.3)) > 0)) = 0),
same as (select list(vec_id order by vec_id) as ids from embeddings group by embedding having count(*) > 1),
u as (select distinct ids from (select ids from mutual union all select ids from same))
select "group", count(distinct label) as sources, count(distinct vec_id % 7) as owners, min(vec_id) as first_seen, max(vec_id) as last_seen, count(*) as n
from (select md5(array_to_string(ids, ',')) as "group", unnest(ids) as vec_id from u) join embeddings using (vec_id) group by 1 having count(distinct label) >= 2
""",
)
def recurrence_clusters(spark, sf_dir):
    """Groups of equal vectors, and of the 8 nearest rows if all are mutually similar, over two labels or more."""
    e = load(spark, sf_dir, "embeddings")
    same = vectors.equal_groups(e, "vec_id", "embedding")
    near = vectors.mutual_groups(e, "vec_id", "embedding", 8, 0.3)
    groups = vectors.united_groups(same, near).withColumn("group", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")))
    members = e.select("vec_id", "label", (F.col("vec_id") % 7).alias("owner"), F.col("vec_id").alias("at"))
    return vectors.recurrence(groups, members, "vec_id", "label", "owner", "at")


@query(
    "amplification_index",
    clusters("vec_id % 20", 0.15, 2)
    + """, e as (select vec_id, vec_id % 20 as g, cast(vec_id * 7 % 90 as varchar) as body, vec_id * 37 % 300 as minute, label, embedding::double[] as v from embeddings),
t as (select g, list(vec_id order by vec_id) as ids from e group by g, body having count(*) > 1),
d as (select distinct g, ids from (select g, list(vec_id order by vec_id) as ids from k group by g, cluster union all select g, ids from t)),
dup as (select g, count(distinct x) as dup from (select g, unnest(ids) as x from d) group by g), big as (select g, count(*) as clusters, max(len(ids)) as most from d group by g),
b as (select g, max(x) as burst from (select a.g, a.vec_id, count(*) as x from e a join e o on o.g = a.g and o.minute between a.minute and a.minute + 10 group by 1, 2) group by g),
again as (select body from e group by body having count(distinct g) > 1), src as (select g, arg_min(v, vec_id) as source from e group by g),
r as (select e.g, count(*) as n, count(*) filter (where body in (select body from again)) as re, count(*) filter (where list_cosine_similarity(source, v) < 0.35) as off from e join src using (g) group by 1),
h as (select g, sum(x * x) as hhi from (select g, label, count(*) * 1.0 / sum(count(*)) over (partition by g) as x from e group by 1, 2) group by g),
p as (select g, n, coalesce(dup, 0) / n as duplicate, greatest(0, (burst - 1) / greatest(1, n - 1)) as burst, re / n as recurrence, off / n as divergence, case when n > 1 then greatest(0, least(1, (hhi - 1.0 / n) / (1 - 1.0 / n))) else 0 end as concentration, coalesce(clusters, 0) as clusters, coalesce(most, 0) / n as largest
 from r left join dup using (g) left join big using (g) left join b using (g) left join h using (g))
select g as video, n as comments, round(duplicate, 6) as duplicate, round(burst, 6) as burst, round(recurrence, 6) as recurrence, round(divergence, 6) as divergence, round(concentration, 6) as concentration,
 round(0.25 * duplicate + 0.2 * burst + 0.2 * recurrence + 0.2 * divergence + 0.15 * concentration, 6) as index, clusters, round(largest, 6) as largest from p""",
)
def amplification_index(spark, sf_dir):
    i = F.col("vec_id")
    at = (F.lit("2026-01-01").cast("timestamp").cast("long") + (i * 37 % 300) * 60).cast("timestamp")
    e = load(spark, sf_dir, "embeddings").select("vec_id", (i % 20).alias("video"), (i * 7 % 90).cast("string").alias("body"), at.alias("at"), F.col("label").alias("narrative"), "embedding")
    again = e.groupBy("body").agg(F.count_distinct("video").alias("n")).where("n > 1")
    sources = e.groupBy("video").agg(F.min_by("embedding", "vec_id").alias("source_vector"))
    got = vectors.amplification(e, sources, e.join(again, "body", "left_semi"), "video", "vec_id", F.col("body"), "at", "embedding", "narrative", near=0.15)
    return got.select("video", "comments", *(F.round(c, 6).alias(c) for c in ("duplicate", "burst", "recurrence", "divergence", "concentration", "index")), "clusters", F.round("largest", 6).alias("largest"))


@query("prototype_relevance", "with p as (select embedding from embeddings where vec_id = 0), q as (select embedding from embeddings where vec_id = 1), s as (select a.vec_id, greatest(0, least(1, 0.5 + list_cosine_similarity(a.embedding::double[], p.embedding::double[]) - list_cosine_similarity(a.embedding::double[], q.embedding::double[]))) as p, a.label = 0 as short from embeddings a, p, q) select vec_id, round(p, 6) as score, case when short then false when p >= 0.65 then true when p <= 0.35 then false end as relevant from s")
def prototype_relevance(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    two = e.where("vec_id = 0").select(F.col("embedding").alias("pos")).crossJoin(e.where("vec_id = 1").select(F.col("embedding").alias("neg")))
    p, decision = vectors.relevance(F.col("embedding"), F.col("pos"), F.col("neg"), F.col("label") == 0)
    return e.crossJoin(F.broadcast(two)).select("vec_id", F.round(p, 6).alias("score"), decision.alias("relevant"))


@query(
    "emerging_themes",
    clusters("label", 0.1)
    + """, w as (select distinct g, cluster, vec_id * 3 % 11 as week from k), r as (select g, cluster, week - row_number() over (partition by g, cluster order by week) as island from w),
s as (select g, cluster, max(n) as streak from (select g, cluster, island, count(*) as n from r group by 1, 2, 3) group by 1, 2), z as (select g, cluster, count(*) as items from k group by 1, 2)
select g || ':' || cluster as theme, streak, items, streak >= 3 or items >= 5 as emerging from s join z using (g, cluster)""",
)
def emerging_themes(spark, sf_dir):
    """Clusters of similar items with a run of weeks or many items."""
    e = load(spark, sf_dir, "embeddings").withColumn("week", F.date_add(F.lit("2026-01-05").cast("date"), (7 * (F.col("vec_id") * 3 % 11)).cast("int")))
    return vectors.emerging_clusters(e, "label", "vec_id", "embedding", "week", 0.1, 3, 5).select("theme", "streak", "items", "emerging")
