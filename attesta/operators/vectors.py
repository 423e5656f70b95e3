"""Similarity and clustering over vectors, and measures built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalar import cosine
from attesta.session import scratch, written

from .ordered import burst, placed, week_streak

#: Vectors of a block, and query rows that are multiplied at a time: a task holds two
#: blocks and one strip of products.
BLOCK_ROWS, STRIP_ROWS = 16_384, 512
#: Pairs whose exact similarities are worked out at a time.
PAIRS = 65_536


def unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows scaled to length 1; zero vectors stay zero."""
    parts = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    sizes = {n for p in parts for n in p.value_lengths().unique().to_pylist()}
    if len(sizes) > 1 or None in sizes:
        raise ValueError("vectors differ in length")
    flat = [np.asarray(p.flatten().to_numpy(zero_copy_only=False), np.float64) for p in parts]
    m = np.concatenate([np.zeros(0), *flat]).reshape(len(vectors), sizes.pop() if sizes else 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


#: Rows of a cell on average, cells at most (their centres are sent to all tasks), rows that centres are fitted on for each
#: cell, and by how much angles may be off.
CELL_ROWS, MOST_CELLS, FIT_ROWS, SLACK = 16_384, 1024, 8, 1e-6


class Cells:
    """Vectors dealt to cells around centres, so that a search can leave out cells that are too far.

    Angles obey the triangle inequality: a row of a cell is no nearer to a vector than the angle
    between vector and centre less the cell's radius.  Zero vectors have a cell of their own, at a
    similarity of 0 to everything.  Rows without a vector take no part.
    """

    def __init__(self, df: DataFrame, key: str, vector: str):
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        self.n = rows.count()
        wanted = min(MOST_CELLS, -(-self.n // CELL_ROWS))
        some = rows.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS * wanted).toArrow()  # a bounded sample
        self.centres = _centres(unit_rows(some.column("vector")), wanted) if self.n else np.zeros((0, 1))
        centres = self.centres

        def run(batches):
            for batch in batches:
                cell, angle = _nearest_cell(unit_rows(batch.column("vector")), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=["key", "vector", "cell", "angle"])

        kinds = dict(rows.dtypes)
        dealt = rows.mapInArrow(run, f"key {kinds['key']}, vector {kinds['vector']}, cell int, angle double")
        self.rows = written(dealt, "cells")
        self.radius, self.size = np.full(len(centres) + 1, -1.0), np.zeros(len(centres) + 1, np.int64)
        for r in self.rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
            self.radius[r.cell], self.size[r.cell] = r.radius, r.n

    def visits(self, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
        """(key, vector, cell, reached) of the queries and each cell they have to meet.

        For ``least``, cells that may hold a similarity of it; for ``k``, cells that may hold one of the k nearest, given
        ``reached``, a similarity that k rows have or null, in the queries.
        """
        centres, radius, size = self.centres, self.radius, self.size

        def run(batches):
            for batch in batches:
                m = unit_rows(batch.column("vector"))
                angle = np.arccos(np.clip(m @ centres.T, -1, 1))
                zero = ~m.any(axis=1)
                low = np.maximum(angle - radius[:-1], 0)
                low[:, radius[:-1] < 0] = np.inf
                low = np.hstack([low, np.full((len(m), 1), np.pi / 2 if size[-1] else np.inf)])
                low[zero] = np.where(size > 0, np.pi / 2, np.inf)
                if least is not None:
                    far = np.full(len(m), np.arccos(np.clip(least, -1, 1)))
                else:
                    # any cells of k rows or more together bound the k-th angle by their farthest ends
                    high = np.hstack([np.minimum(angle + radius[:-1], np.pi), np.full((len(m), 1), np.pi / 2)])
                    high[zero] = np.pi / 2
                    high[:, size == 0] = np.inf
                    order = np.argsort(high, axis=1)
                    enough = (np.cumsum(size[order], axis=1) >= k).argmax(axis=1)
                    far = np.take_along_axis(high, order, 1)[np.arange(len(m)), enough]
                    far[size.sum() < k] = np.pi
                    known = batch.column("reached").to_numpy(zero_copy_only=False).astype(np.float64)
                    far = np.fmin(far, np.arccos(np.clip(known, -1, 1)))
                row, cell = np.nonzero(low <= far[:, None] + SLACK)
                taken = batch.take(pa.array(row))
                reached = taken.column("reached") if least is None else pa.nulls(len(row), pa.float64())
                yield pa.RecordBatch.from_arrays([taken.column("key"), taken.column("vector"), pa.array(np.where(cell == len(centres), -1, cell), pa.int32()), reached], names=["key", "vector", "cell", "reached"])

        kinds = dict(queries.dtypes)
        return queries.mapInArrow(run, f"key {kinds['key']}, vector {kinds['vector']}, cell int, reached double")

    def meet(self, visits: DataFrame, run, schema: str, first_only: bool = False) -> DataFrame:
        """``run`` over blocks of a cell's rows and of its visitors, BLOCK_ROWS of each or so."""
        spark = self.rows.sparkSession
        told = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        blocks = lambda n: max(1, -(-int(n) // BLOCK_ROWS))
        sizes = spark.createDataFrame([(c, blocks(self.size[c]), blocks(told[c])) for c in told], "cell int, subs int, parts int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        draw = lambda c, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(c)).cast("int")
        near, met = F.broadcast(sizes), ["cell", "sub", "part", "side", "key", "vector", "reached"]
        left = visits.join(near, "cell").withColumn("sub", F.lit(0) if first_only else every("subs")).withColumns({"part": draw("parts", 1), "side": F.lit(0)})
        right = self.rows.withColumn("reached", F.lit(None).cast("double")).join(near, "cell").withColumn("sub", draw("subs", 2)).withColumns({"part": every("parts"), "side": F.lit(1)})
        right = right.where("sub = 0") if first_only else right
        return left.select(*met).union(right.select(*met)).groupBy("cell", "sub", "part").applyInArrow(run, schema)

    def pairs(self, visits: DataFrame) -> int:
        """How many pairs of a visitor and a row meet; all pairs are visitors times rows."""
        return sum(r.n * int(self.size[r.cell]) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect())


def _centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit centres of a sample by a few rounds of means."""
    sample = sample[sample.any(axis=1)]
    if not len(sample):
        return sample
    centres = sample[:wanted]
    for _ in range(5):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _nearest_cell(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and angle to its centre; -1 and 0 for zero vectors."""
    if not len(m) or not len(centres):
        return np.full(len(m), -1), np.zeros(len(m))
    sim = m @ centres.T
    cell = sim.argmax(axis=1)
    zero = ~m.any(axis=1)
    angle = np.arccos(np.clip(sim[np.arange(len(m)), cell], -1, 1))
    return np.where(zero, -1, cell), np.where(zero, 0, angle)


def _best(k: int):
    """Function of one block of visitors (side 0) and rows (side 1): each visitor's k nearest, ties by key."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        keys = table.column("key").to_numpy()
        m = unit_rows(table.column("vector"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parts = [pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})]
        take = min(k, len(b))
        # single precision tells what may be near enough, double precision what is
        rough, theirs, reached = m.astype(np.float32), keys[b], table.column("reached").to_numpy(zero_copy_only=False).astype(np.float64)
        other, slack = rough[b].T, 1e-6 + m.shape[1] * 2.0**-22
        for lo in range(0, len(a) if take else 0, STRIP_ROWS):
            mine = a[lo : lo + STRIP_ROWS]
            near = rough[mine] @ other
            floor = reached[mine]
            bare = np.flatnonzero(np.isnan(floor))
            if len(bare):
                floor[bare] = np.partition(near[bare], -take, axis=1)[:, -take]
            row, col = np.nonzero(near >= (floor - 2 * slack)[:, None].astype(np.float32))
            sim = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", m[mine[row[n : n + PAIRS]]], m[b[col[n : n + PAIRS]]]) for n in range(0, len(row), PAIRS))])
            sim = np.round(sim, 12)
            order = np.lexsort((theirs[col], -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            first = np.searchsorted(row, np.arange(len(mine)))
            kept = np.arange(len(row)) - first[row] < take
            parts.append(pa.table({"query": keys[mine][row[kept]], "neighbour": theirs[col[kept]], "cosine": sim[kept]}))
        return pa.concat_tables(parts)

    return run


def nearest_visits(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(key, vector, cell) that a search of the k nearest needs: each query first meets a block of
    its own cell, and then every cell that may hold a row as near as the k-th of these."""
    centres = cells.centres

    def own(batches):
        for batch in batches:
            cell, _ = _nearest_cell(unit_rows(batch.column("vector")), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.nulls(len(cell), pa.float64())], names=["key", "vector", "cell", "reached"])

    asked = queries.where("vector is not null").select("key", "vector")
    kinds = dict(asked.dtypes)
    at_home = asked.mapInArrow(own, f"key {kinds['key']}, vector {kinds['vector']}, cell int, reached double")
    found = cells.meet(at_home, _best(k), "query long, neighbour long, cosine double", first_only=True)
    reached = found.groupBy("query").agg(F.count("*").alias("_n"), F.min("cosine").alias("reached")).where(F.col("_n") >= k)
    rows = asked.join(reached.select(F.col("query").alias("key"), "reached"), "key", "left")
    return written(cells.visits(rows, k=k), "visits")


def knn(df: DataFrame, key: str, vector: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query, neighbour, cosine, rank) of the k nearest, itself included; ties by key.

    Exact: only cells that the triangle inequality rules out are left out.  On vectors without clusters
    nothing is ruled out and every block meets every block.
    """
    cells = Cells(df, key, vector)
    asked = (queries if queries is not None else df).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    near = cells.meet(nearest_visits(cells, asked, k), _best(k), "query long, neighbour long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(a, b, cosine) with a < b and cosine of ``least`` or more, from the cells near enough."""

    def run(table: pa.Table) -> pa.Table:
        side, keys = table.column("side").to_numpy(), table.column("key").to_numpy()
        m = unit_rows(table.column("vector"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parts = [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})]
        for lo in range(0, len(a) if len(b) else 0, STRIP_ROWS):
            mine = a[lo : lo + STRIP_ROWS]
            sim = m[mine] @ m[b].T
            i, j = np.nonzero((sim >= least) & (keys[mine][:, None] < keys[b][None, :]))
            parts.append(pa.table({"a": keys[mine][i].astype(np.int64), "b": keys[b][j].astype(np.int64), "cosine": sim[i, j]}))
        return pa.concat_tables(parts)

    cells = Cells(df, key, vector)
    visits = written(cells.visits(cells.rows.select("key", "vector"), least=least), "visits")
    return cells.meet(visits, run, "a long, b long, cosine double")


#: Rows of a group that are told in one task, one after another.
RANGE_ROWS = 8192


def _first_fit(m: np.ndarray, least: float, fits: list[np.ndarray] | None = None, earlier: int = 0) -> np.ndarray:
    """Cluster numbers of rows in order: a row joins the first cluster whose every member is similar, or begins one.

    Numbers under ``earlier`` are of clusters that are there already; ``fits`` has, in order, those whose members so far
    are all similar to a row.
    """
    home, size, top = np.zeros(len(m), np.int64), np.zeros(earlier + len(m), np.int64), earlier
    for lo in range(0, len(m), STRIP_ROWS):
        hi = min(lo + STRIP_ROWS, len(m))
        near = m[lo:hi] @ m[:hi].T >= least - 1e-12
        for i in range(lo, hi):
            whole = np.bincount(home[:i][near[i - lo, :i]], minlength=top) == size[:top]
            old = fits[i][whole[fits[i]]] if fits is not None else ()
            new = whole[earlier:].argmax() if top > earlier else 0
            if len(old):
                home[i] = old[0]
            elif top > earlier and whole[earlier + new]:
                home[i] = earlier + new
            else:
                home[i], top = top, top + 1
            size[home[i]] += 1
    return home


def complete_link(df: DataFrame, by: str, key: str, vector: str, least: float, smallest: int = 1) -> DataFrame:
    """(by, cluster, key) of greedy complete-link clusters, scanned in key order.

    A row joins the first cluster whose every member is at least ``least``
    similar.  Groups of up to RANGE_ROWS rows are a task each; larger ones go in rounds, see
    ``_in_rounds``.  Rows without a vector take no part.
    """
    kind = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column(key).to_pylist()), kind="stable")
        table = table.take(pa.array(order))
        home = _first_fit(unit_rows(table.column(vector)), least)
        size = np.bincount(home)
        number = np.cumsum(size >= smallest) - 1
        at = np.flatnonzero(size[home] >= smallest)
        out = table.select([by, key]).take(pa.array(at, pa.int64()))
        return out.append_column("cluster", pa.array(number[home[at]], pa.int32()))

    rows = df.where(F.col(vector).isNotNull()).select(by, key, vector)
    large = rows.groupBy(F.col(by).alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > RANGE_ROWS).select("_large")
    same, schema = F.col(by).eqNullSafe(F.col("_large")), f"{by} {kind[by]}, {key} {kind[key]}, cluster int"
    if large.isEmpty():
        return rows.groupBy(by).applyInArrow(run, schema)
    own = rows.join(large, same, "left_anti").groupBy(by).applyInArrow(run, schema)
    return own.union(_in_rounds(rows.join(large, same, "left_semi"), by, key, vector, least, smallest))


def _in_rounds(df: DataFrame, by: str, key: str, vector: str, least: float, smallest: int) -> DataFrame:
    """Complete-link clusters of large groups, RANGE_ROWS rows of each group a round, in key order.

    A round's rows meet their group's members of earlier rounds in blocks of whole clusters, so that a block tells
    by itself whether all members of a cluster are similar to a row: only then it is a candidate.  Clusters of over a quarter of a block
    are dealt to several, whose counts have to make up the cluster.  One task a group then tells the round's rows one after another,
    from candidates and their own similarities.  Pairs are never written.  Of equal vectors only the first is told: what later ones join is the same.
    """
    rows = placed(df, F.struct(by, key), [], "_at", nulls_first=True)
    starts = rows.groupBy(by).agg(F.min("_at").alias("_first"), F.count("*").alias("_all"))
    rows = rows.join(starts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    # vectors of no length are not similar to each other
    alone = F.when(~F.exists(vector, lambda x: x != 0), F.col("_at"))
    rows = written(rows.withColumn("_alone", alone), "linked")
    firsts = rows.groupBy("_first", vector, "_alone").agg(F.min("_at").alias("code"))
    firsts = written(firsts.withColumn("round", F.expr(f"(code - _first) div {RANGE_ROWS}")), "firsts")

    def counted(table: pa.Table) -> pa.Table:
        code, group = table.column("code").to_numpy(), table.column("cluster").to_numpy(zero_copy_only=False)
        mine = table.column("mine").to_numpy(zero_copy_only=False)
        m = unit_rows(table.column("vector"))
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        parts = [pa.table({"code": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        if len(a) and len(b):
            b = b[np.argsort(group[b], kind="stable")]
            names, begin, size = np.unique(group[b].astype(np.int64), return_index=True, return_counts=True)
            theirs = m[b].T
            for lo in range(0, len(a), STRIP_ROWS):
                strip = a[lo : lo + STRIP_ROWS]
                i, j = np.nonzero(np.logical_and.reduceat(m[strip] @ theirs >= least - 1e-12, begin, axis=1))
                parts.append(pa.table({"code": code[strip][i], "cluster": names[j], "n": size[j].astype(np.int64)}))
        return pa.concat_tables(parts)

    def told(table: pa.Table) -> pa.Table:
        """Members of one group's rows of a round; a cluster is named by its first member."""
        table = table.sort_by("code")
        code, fits = table.column("code").to_numpy(), table.column("fits").to_pylist()
        old = np.unique(np.array([c for own in fits for c in own or ()], np.int64))
        home = _first_fit(unit_rows(table.column("vector")), least, [np.searchsorted(old, np.sort(np.array(own or (), np.int64))) for own in fits], len(old))
        first = np.zeros(max(home.max() + 1, len(old)), np.int64)
        first[: len(old)] = old
        started, at = np.unique(home, return_index=True)
        new = started >= len(old)
        first[started[new]] = code[at[new]]
        return table.select(["_first", "code", "vector"]).append_column("cluster", pa.array(first[home], pa.int64()))

    path, kinds = scratch(df.sparkSession, "members"), dict(df.dtypes)
    schema = f"_first long, code long, vector {kinds[vector]}, cluster long"
    last = firsts.agg(F.max("round")).first()[0]
    for number in range(last + 1):
        mine = firsts.where(F.col("round") == number).select("_first", "code", F.col(vector).alias("vector"))
        if number:
            members = df.sparkSession.read.schema(schema).parquet(f"{path}/*")
            blocks = F.broadcast(members.groupBy("_first").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
            # of clusters as large there are a few a block of rows
            most = max(1, BLOCK_ROWS // 4)
            large = F.broadcast(members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > most))
            sub = F.pmod(F.xxhash64("code"), F.coalesce(F.ceil(F.col("size") / most), F.lit(1)))
            theirs = members.join(blocks, "_first").join(large, "cluster", "left").withColumn("block", F.pmod(F.xxhash64("cluster", sub), F.col("blocks")).cast("int"))
            asked = mine.join(blocks, "_first").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cluster", F.lit(None).cast("long"))
            met = ["_first", "block", "code", "vector", "cluster"]
            both = asked.select(*met, F.lit(True).alias("mine")).union(theirs.select(*met, F.lit(False)))
            found = both.groupBy("_first", "block").applyInArrow(counted, "code long, cluster long, n long").join(large, "cluster", "left")
            parted = found.where("size is not null").groupBy("code", "cluster", "size").agg(F.sum("n").alias("n")).where("n = size").select("code", "cluster")
            fits = found.where("size is null").select("code", "cluster").union(parted).groupBy("code").agg(F.collect_list("cluster").alias("fits"))
            mine = mine.join(fits, "code", "left").select("_first", "code", "vector", "fits")
        else:
            mine = mine.withColumn("fits", F.lit(None).cast("array<long>"))
        mine.groupBy("_first").applyInArrow(told, schema).write.parquet(f"{path}/round-{number:06d}")
    members = df.sparkSession.read.schema(schema).parquet(f"{path}/*").select("code", "cluster")
    copies = rows.join(firsts.drop("round", "_alone"), ["_first", vector]).where(F.col("_alone").isNull() | (F.col("code") == F.col("_at")))
    got = copies.join(members, "code").select(by, "_first", key, F.col("cluster").alias("name"))
    names = got.groupBy("_first", "name").agg(F.count("*").alias("_n")).where(F.col("_n") >= smallest)
    names = names.withColumn("cluster", (F.row_number().over(Window.partitionBy("_first").orderBy("name")) - 1).cast("int"))
    return got.join(names, ["_first", "name"]).select(by, key, "cluster")


def centroid(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector of each group, in position order."""
    flat = df.select(*by, F.posexplode(vector).alias("i", "v")).groupBy(*by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return flat.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def exact_groups(df: DataFrame, by: list[str], text: Column) -> DataFrame:
    """(by, text, n, keys) of normalised texts that occur more than once."""
    return df.withColumn("norm", text).groupBy(*by, "norm").agg(F.count("*").alias("n")).where("n > 1")


def equal_groups(df: DataFrame, key: str, what: str) -> DataFrame:
    """(ids) of the rows that are equal in a column, two or more."""
    return df.where(F.col(what).isNotNull()).groupBy(what).agg(F.array_sort(F.collect_list(key)).alias("ids")).where(F.size("ids") > 1).select("ids")


def mutual_groups(df: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """(ids) of each row's ``k`` nearest of ``least`` or more, if all pairs of them reach ``least``."""
    near = knn(df, key, vector, k).where(F.col("cosine") >= least).select("query", F.col("neighbour").alias("id"))
    members = near.join(df.select(F.col(key).alias("id"), F.col(vector).alias("v")), "id")
    got = members.groupBy("query").agg(F.collect_list(F.struct("id", "v")).alias("m")).where(F.size("m") > 1)
    alike = F.forall("m", lambda a: F.forall("m", lambda b: (a["id"] >= b["id"]) | (F.round(cosine(a["v"], b["v"]), 12) >= least)))
    return got.where(alike).select(F.array_sort(F.transform("m", lambda a: a["id"])).alias("ids"))


def united_groups(*groups: DataFrame) -> DataFrame:
    """Distinct groups, each a sorted id array ``ids``."""
    out = groups[0].select(F.array_sort("ids").alias("ids"))
    for g in groups[1:]:
        out = out.union(g.select(F.array_sort("ids").alias("ids")))
    return out.dropDuplicates(["ids"])


def injection(clusters: DataFrame, members: DataFrame, sources: DataFrame, by: str, key: str, vector: str, label: str, far: float = 0.35, smallest: int = 3) -> DataFrame:
    """Share of a source's comments in clusters that bring in another narrative.

    A cluster counts if it has ``smallest`` members, its centroid is less than
    ``far`` similar to the source, and its labels are disjoint from the
    source's (``none_unclear`` on neither side, ``other`` not on the cluster's).
    """
    rows = members.join(clusters, [by, key])
    labels = rows.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.array_except(F.collect_set(label), F.array(F.lit("none_unclear"), F.lit("other"))).alias("labels"))
    got = labels.join(centroid(rows, [by, "cluster"], vector), [by, "cluster"]).join(sources.select(by, "source_vector", "source_labels"), by)
    own = F.array_except("source_labels", F.array(F.lit("none_unclear")))
    ok = (F.col("n") >= smallest) & (cosine(F.col("centroid"), F.col("source_vector")) < far) & (F.size("labels") > 0) & (F.size(own) > 0) & ~F.arrays_overlap("labels", own)
    share = got.groupBy(by).agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("inside"))
    totals = members.groupBy(by).agg(F.count("*").alias("total"))
    out = sources.select(by).join(totals, by, "left").join(share, by, "left")
    return out.select(by, F.when(F.col("total") > 0, F.coalesce("inside", F.lit(0)) / F.col("total")).alias("injection"))


def duplicate_groups(comments: DataFrame, by: str, key: str, text: Column, vector: str, near: float) -> DataFrame:
    """(by, ids): complete-link clusters of similar vectors and groups of equal texts,
    two members or more, each set of ids once."""
    clusters = complete_link(comments, by, key, vector, near, 2).groupBy(by, "cluster").agg(F.array_sort(F.collect_list(key)).alias("ids")).select(by, "ids")
    equal = comments.withColumn("_t", text).groupBy(by, "_t").agg(F.array_sort(F.collect_list(key)).alias("ids")).where(F.size("ids") > 1).select(by, "ids")
    return clusters.union(equal).distinct()


def amplification(comments: DataFrame, sources: DataFrame, recurring: DataFrame, by: str, key: str, text: Column, at: str, vector: str, narrative: str, near: float = 0.92, far: float = 0.35, seconds: int = 600) -> DataFrame:
    """(by, comments, five components, index, clusters, largest) of each source with comments.

    duplicate: share of comments in near or exact groups; burst: the most within
    ``seconds``, less one, over the others; recurrence: share that recurs
    elsewhere (``recurring`` has their keys); divergence: share less than ``far``
    similar to the source (``sources``: by, source_vector); concentration of
    narratives over the number of comments, normalised and clipped to 0 to 1.
    """
    groups = duplicate_groups(comments, by, key, text, vector, near)
    in_groups = groups.select(by, F.explode("ids").alias(key)).groupBy(by).agg(F.count_distinct(key).alias("_dup"))
    sizes = groups.groupBy(by).agg(F.count("*").alias("clusters"), F.max(F.size("ids")).alias("_most"))
    rows = comments.join(recurring.select(key).distinct().withColumn("_again", F.lit(1)), key, "left").join(sources.select(by, "source_vector"), by)
    n = rows.groupBy(by).agg(F.count("*").alias("comments"), F.count("_again").alias("_again"), F.count_if(cosine(F.col("source_vector"), F.col(vector)) < far).alias("_far"))
    told = comments.groupBy(by, narrative).agg(F.count("*").alias("_k")).groupBy(by).agg((F.sum(F.col("_k") * F.col("_k")) / (F.sum("_k") * F.sum("_k"))).alias("_hhi"))
    out = n.join(in_groups, by, "left").join(sizes, by, "left").join(burst(comments, by, at, seconds), by, "left").join(told, by, "left")
    count = F.col("comments")
    spread = F.when(count > 1, (F.col("_hhi") - 1 / count) / (1 - 1 / count)).otherwise(0.0)
    parts = {
        "duplicate": F.coalesce("_dup", F.lit(0)) / count,
        "burst": F.greatest(F.lit(0.0), (F.col("burst") - 1) / F.greatest(F.lit(1), count - 1)),
        "recurrence": F.col("_again") / count,
        "divergence": F.col("_far") / count,
        "concentration": F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread)),
    }
    index = sum((c * WEIGHTS[name] for name, c in parts.items()), F.lit(0.0))
    return out.select(by, "comments", *(c.alias(name) for name, c in parts.items()), index.alias("index"), F.coalesce("clusters", F.lit(0)).alias("clusters"), (F.coalesce("_most", F.lit(0)) / count).alias("largest"))


#: Component weights of the amplification index.
WEIGHTS = {"duplicate": 0.25, "burst": 0.2, "recurrence": 0.2, "divergence": 0.2, "concentration": 0.15}


def recurrence(groups: DataFrame, members: DataFrame, key: str, source: str, owner: str, at: str) -> DataFrame:
    """Groups over two sources or more: counts of sources and owners, first and last seen."""
    rows = groups.select("group", F.explode("ids").alias(key)).join(members, key)
    got = rows.groupBy("group").agg(F.count_distinct(source).alias("sources"), F.count_distinct(owner).alias("owners"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))
    return got.where("sources >= 2")


def representatives(clusters: DataFrame, by: str, key: str) -> DataFrame:
    """Each member with its cluster's first key and how its label comes about."""
    lead = clusters.groupBy(by, "cluster").agg(F.min(key).alias("representative"))
    return clusters.join(lead, [by, "cluster"]).withColumn("provenance", F.when(F.col(key) == F.col("representative"), "direct").otherwise("propagated"))


def relevance(vector: Column, positive: Column, negative: Column, short: Column) -> tuple[Column, Column]:
    """(score, decision): .65 and more true, .35 and less false, between unknown."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + cosine(vector, positive) - cosine(vector, negative)))
    return p, F.when(short, False).when(p >= 0.65, True).when(p <= 0.35, False)


def emerging(items: DataFrame, label: str, week: str, streak: int = 3, volume: int = 15) -> DataFrame:
    """Themes with a run of ``streak`` weeks or ``volume`` items."""
    runs = week_streak(items, label, week)
    n = items.groupBy(label).agg(F.count("*").alias("items"))
    return runs.join(n, label).withColumn("emerging", (F.col("streak") >= streak) | (F.col("items") >= volume))


def emerging_clusters(items: DataFrame, by: str, key: str, vector: str, week: str, least: float, streak: int = 3, volume: int = 15) -> DataFrame:
    """The same for complete-link clusters of the items of each ``by``; theme is ``by:cluster``."""
    clusters = complete_link(items, by, key, vector, least).withColumn("theme", F.concat_ws(":", F.col(by).cast("string"), F.col("cluster").cast("string")))
    return emerging(clusters.join(items.select(key, week), key), "theme", week, streak, volume)
