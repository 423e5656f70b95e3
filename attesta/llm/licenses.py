"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

Built from DataFrame functions only.  Texts without any word of licensing are
left out.  Of the others these are compared with templates: each line that
holds such a word; blocks of lines that hold one, which are two or three
successive lines, paragraphs and runs of comment lines; and the whole text.
Templates are one-line notices, SPDX tags and full license texts
(``license_texts``).
Equal lines or blocks are one with a count, so a notice on a third of all files
is compared once.  Each is a sparse vector of lower-case word weights
``tf * idf`` (idf over all lines, or all blocks and whole texts, counted with
their repetitions, and the templates); dot products are one join on words.  A
cosine of MIN_COSINE to a notice, or MIN_TEXT to a full text, declares that
license, ties to the smaller license name.  Telling terms (TWINS) give near twins
of a full text, as AGPL-3.0 of GPL-3.0 or BSD-2-Clause of BSD-3-Clause, their own
name; a Creative Commons notice of parts that no template has declares nothing.

A file whose parts declare a license has it itself; of several, a full text
that the whole file is goes first, then the best cosine, then the smaller name.
A file that is a template as a whole, or of which declaring lines make up half
of the words or more, is a licence file and also declares its directory
(of several, the license of most files, then the smaller name).  Every other
file inherits from the nearest ancestor directory with a license.  Directories
are resolved once each, by a join of their ancestor paths.

Null and empty texts declare nothing and inherit.  A null path has no
ancestors.  Repeated rows, and rows without a file id, are files of their own, as
what a file says follows from its text alone.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

MIN_COSINE = 0.6
#: Higher than for notices: long English texts share their frequent words.
MIN_TEXT = 0.85
#: Words of licensing; lines and texts without any are left out.
WORDING = ("licens", "licenc", "copyright", "spdx", "public domain", "permission is hereby", "redistribution and use")

#: Short notices of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def tags(names: list[str]) -> list[tuple[str, str]]:
    """(license, notice) of the SPDX tags of licenses."""
    forms = lambda n: [n, f"{n}-only", f"{n}-or-later"] if "GPL" in n else [n]
    return [(n, f"SPDX-License-Identifier: {f}") for n in sorted(set(names)) for f in forms(n)]


#: Lines that do not begin with a mark of comments.
NO_COMMENT = r"(?m)^(?![\x20\t]*(?:#|//|/?\*|--|;|%)).*$"


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the full texts, read on the driver."""
    return [(p.name.removesuffix(".txt"), p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def _worded(text: Column) -> Column:
    """Whether a text has a word of licensing: plain searches, faster than one pattern."""
    low = F.lower(text)
    out = F.lit(False)
    for w in WORDING:
        out = out | F.contains(low, F.lit(w))
    return out


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*+"), 0)


def _weights(lines: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of a DataFrame with the columns key and text."""
    return lines.select(key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _text_id() -> Column:
    """Texts, not files, declare licenses: equal texts once, whatever their files are called."""
    return _key(F.coalesce("text", F.lit("")))


def _key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def header_lines(files: DataFrame) -> DataFrame:
    """(file, at, line, text, n_words, line_words) of every line with a word of licensing; line is a hash."""
    count = lambda c: F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))
    # words of the whole text are counted once, not for each line, and the text is not copied to its lines
    own = files.where(_worded(F.col("text"))).select("file", count(F.col("text")).alias("n_words"), F.split("text", "\n").alias("lines"))
    lines = own.select("file", "n_words", F.posexplode("lines").alias("at", "line")).where(_worded(F.col("line")))
    return lines.select("file", "at", _key(F.col("line")).alias("line"), F.col("line").alias("text"), "n_words", count(F.col("line")).alias("line_words"))


def blocks(files: DataFrame) -> DataFrame:
    """(file, line, text, whole) of blocks of lines and whole texts; line is a hash."""
    texts = files.where(_worded(F.col("text"))).select("file", "text", F.split("text", "\n").alias("lines"))
    wide = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("lines") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("lines", i, n), "\n"))
    runs = F.split(F.regexp_replace("text", NO_COMMENT, "\0"), "\0")
    parts = F.array_distinct(F.concat(wide(2), wide(3), F.split("text", r"\n[\x20\t\r]*\n"), runs))
    parts = F.filter(parts, lambda p: _worded(p) & (p != F.col("text")))
    both = F.concat(F.array(F.struct("text", F.lit(True).alias("whole"))), F.transform(parts, lambda p: F.struct(p.alias("text"), F.lit(False).alias("whole"))))
    return texts.select("file", F.explode(both).alias("b")).select("file", _key(F.col("b.text")).alias("line"), "b.text", "b.whole")


def match_lines(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(line, license, cosine, full) of distinct lines and their best templates.

    ``lines`` is (line, text, times), where line is the key; ``templates`` is
    (license, text, full).
    """
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"] + templates.count()
    templates = templates.withColumn("template", F.struct("license", "full", F.sha1("text").alias("id")))
    of_lines = _weights(lines, "line")
    of_templates = _weights(templates, "template")
    df = of_lines.join(lines.select("line", "times"), "line").groupBy("term").agg(F.sum("times").alias("df"))
    df = df.union(of_templates.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = df.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    a = of_lines.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    b = of_templates.join(idf, "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norm_a = a.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    norm_b = b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nb"))
    dot = a.join(b, "term").groupBy("line", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cos = dot.join(norm_a, "line").join(norm_b, "template").select("line", "template", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 9).alias("cosine"))
    near = cos.where(F.col("cosine") >= F.when(F.col("template.full"), MIN_TEXT).otherwise(MIN_COSINE))
    told = near.join(lines.select("line", "text"), "line").select("line", "cosine", F.col("template.full").alias("full"), twin(F.col("template.license"), F.col("text"), F.col("template.full")).alias("license"))
    best = told.where("license is not null").groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("back"), "license", "full")).alias("m"))
    return best.select("line", F.col("m.license").alias("license"), (-F.col("m.back")).alias("cosine"), F.col("m.full").alias("full"))


#: Terms that tell a license from its near twins, as (license, twin, pattern, least, most).  A
#: text that is near the license's full text but has the pattern fewer or more times is the twin.
TWINS = (
    ("GPL-3.0", "AGPL-3.0", r"affero", 0, 8),
    ("GPL-2.0", "LGPL-2.0", r"gnu\s+(?:library|lesser)\s+general\s+public", 0, 6),
    ("BSD-3-Clause", "BSD-4-Clause", r"advertising\s+materials\s+mentioning", 0, 0),
    ("BSD-3-Clause", "BSD-2-Clause", r"endorse\s+or\s+promote", 1, 99),
    ("MIT", "MIT-0", r"permission\s+notice(?:\s+\([^)]*\))?\s+shall\s+be\s+included", 1, 99),
    ("ISC", "0BSD", r"permission\s+notice\s+appear\s+in\s+all\s+copies", 1, 99),
)


def twin(license_: Column, text: Column, full: Column) -> Column:
    """The name that a text's telling terms leave of a match; null where a notice tells of a license without template."""
    low, out = F.lower(text), license_
    for name, other, pattern, least, most in reversed(TWINS):
        out = F.when(full & (license_ == name) & ~F.regexp_count(low, F.lit(pattern)).between(least, most), other).otherwise(out)
    # what stands behind a Creative Commons "by" has to be what the template has
    said = F.regexp_extract(low, r"\bcc[\s-]+by((?:-(?:nc|sa|nd))*)\b", 1)
    named = F.upper(F.concat(F.lit("CC-BY"), said))
    cc = ~full & license_.startswith("CC-BY") & low.rlike(r"\bcc[\s-]+by\b")
    return F.when(cc & (F.regexp_replace(license_, "-[0-9.]+$", "") != named), None).otherwise(out)


def ancestors(directory: Column) -> Column:
    """The directory and its ancestors, nearest first; empty for null."""
    parts = F.split(directory, "/")
    paths = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(directory.isNotNull(), paths).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(file, path, license, origin, cosine, from_dir) of files (file, path, text).

    origin is ``header``, ``inherited`` or ``none``.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame([*TEMPLATES, *tags([n for n, _ in TEMPLATES])], "license string, line string")
    notices = templates.select("license", F.col("line").alias("text"), F.lit(False).alias("full"))
    texts = spark.createDataFrame(full_texts(), "license string, text string").withColumn("full", F.lit(True))
    by_text = work.cut(files.where(_worded(F.col("text"))).select(_text_id().alias("file"), "text"), "worded")
    heads = work.cut(header_lines(by_text), "headers")
    parts = work.cut(blocks(by_text), "blocks")
    known = work.cut(match_lines(heads.groupBy("line").agg(F.first("text").alias("text"), F.count("*").alias("times")), notices), "notices")
    alike = work.cut(match_lines(parts.groupBy("line").agg(F.first("text").alias("text"), F.count("*").alias("times")), notices.union(texts)), "alike")
    work.release(spark)
    said = heads.drop("text").dropDuplicates(["file", "at"]).join(work.small_or_not(known, known.count(), 100), "line").select("file", "license", "cosine", F.lit(False).alias("all"), "full", "line_words", "n_words")
    shown = parts.select("file", "line", "whole").distinct().join(work.small_or_not(alike, alike.count(), 100), "line")
    shown = shown.select("file", "license", "cosine", F.col("whole").alias("all"), "full", F.lit(0).alias("line_words"), F.lit(1).alias("n_words"))
    own = said.union(shown).groupBy("file").agg(
        F.min(F.struct((~(F.col("all") & F.col("full"))).alias("part"), (-F.col("cosine")).alias("back"), "license")).alias("m"),
        ((2 * F.sum("line_words") >= F.max("n_words")) | F.bool_or("all")).alias("whole"),
    )
    own = work.cut(own.select(F.col("file").alias("text_id"), F.col("m.license").alias("license"), (-F.col("m.back")).alias("cosine"), "whole"), "own")
    where = files.select("file", "path", _text_id().alias("text_id"), F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "").alias("dir"))
    work.release(spark)
    rows = work.cut(_declared(where, own), "declared")
    votes = rows.where("whole and dir is not null").groupBy("dir", "license").agg(F.count("*").alias("n"))
    first = Window.partitionBy("dir").orderBy(F.desc("n"), "license")
    declared = votes.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("dir").alias("up"), F.col("license").alias("dir_license"))
    up = rows.select("dir").where("dir is not null").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "up"))
    nearest = up.join(declared, "up").groupBy("dir").agg(F.min(F.struct("far", "up", "dir_license")).alias("m")).select("dir", F.col("m.up").alias("from_dir"), "m.dir_license")
    nearest = work.cut(nearest, "nearest")
    out = rows.join(work.small_or_not(nearest, nearest.count(), 400), "dir", "left")
    return out.select(
        "file",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "cosine",
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def _declared(where: DataFrame, own: DataFrame) -> DataFrame:
    """Files with what their texts declare.  If those texts are not few, a filter of
    them parts the files, and only files that it may hold are shuffled."""
    from .urls import bloom_flag

    n = own.count()
    if n * 120 <= work.BROADCAST_BYTES:
        return where.join(F.broadcast(own), "text_id", "left").drop("text_id")
    flagged = bloom_flag(where.withColumn("h", F.xxhash64("text_id")), own.select(F.xxhash64("text_id").alias("h")), n)
    some = flagged.where("maybe").drop("maybe").join(own, "text_id", "left")
    none = flagged.where("not maybe").drop("maybe")
    return some.unionByName(none, allowMissingColumns=True).drop("text_id")


def as_files(docs: DataFrame) -> DataFrame:
    """documents as files: ``source/<doc_id div 64>/<doc_id>``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("cast(doc_id div 64 as string)"), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(as_files(work.table(spark, sf_dir, "documents")))
    return got.withColumnRenamed("file", "doc_id")
