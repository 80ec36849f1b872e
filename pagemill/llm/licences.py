"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest directory above.

Headers are the lines of a whole text that speak of a licence. Lines become sparse TF-IDF vectors over the words of all
headers; the templates' vectors are a small table, and their cosines come from a join on words. Texts that use words of
licences get a vector as a whole too, over pairs of neighbouring words (single words can't tell a licence from other English
prose), against the full texts in licence_texts. Licence files are texts like a full text, texts that are mostly headers, and
those of such a name. A file without a licence of its own takes that of the nearest ancestor directory with a licence file, by
a join on paths.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged

# Short forms by which licences are named in headers.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["Copyright. All rights reserved."],
}
HEADER = r"(?i)(?<![a-z])(licen[sc]ed?|licen[sc]es|copyright|spdx-license-identifier|all rights reserved|public domain)(?![a-z])"
# What a text that is a licence as a whole can't do without; HEADER's words are among them.
LIKE = r"(?i)(?<![a-z])(licen[sc]e|copyright|spdx-license|all rights reserved|public domain|permission|redistribution|warrant(y|ies))"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
HEADER_WORD = r"(?i)(licen[sc]ed?|licen[sc]es|copyright|spdx-license-identifier)(?![a-z])"
#: Words of a sentence whose header words are looked round, and the lengths of what is compared there.
LONG_SENTENCE, WINDOWS = 16, (5, 8, 12)
LEAST, SHARE, WORD = 0.75, 0.5, r"[a-z0-9]+(?:\.[0-9]+)*"


AFFERO = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all
users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive
the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through
some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding
Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed
under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this
License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by
version 3 of the GNU General Public License."""


def _words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def full_texts() -> dict[str, str]:
    """The full licences; the Affero one is the GPL with its own name and section 13."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    gpl = texts["GPL-3.0"]
    start, end = gpl.index("13. Use with the GNU Affero"), gpl.index("14. Revised Versions")
    gnu = gpl[:start] + gpl[end:]
    for old, new in (("GNU General Public", "GNU Affero General Public"), ("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")):
        gnu = gnu.replace(old, new)
    return texts | {"AGPL-3.0": f"{gnu}\n{AFFERO}"}


def whole_matches(like: DataFrame, least: float = LEAST) -> DataFrame:
    """path, licence, score of the texts (path, text) that are like a full licence; the best one, ties by licence name."""
    spark = like.sparkSession
    words = _words("text")
    pairs = F.explode(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))).alias("pair")
    keyed = like.withColumn("key", F.sha2("text", 256))
    # Equal texts are one vector.
    counted = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    counts = counted.select("key", "n", pairs).groupBy("key", "n", "pair").agg(F.count("*").alias("tf"))
    rows = list(full_texts().items())
    templates = spark.createDataFrame(rows, "licence string, text string")
    forms = templates.select("licence", pairs).groupBy("licence", "pair").agg(F.count("*").alias("tf"))
    total = keyed.count()
    used = forms.select("pair").distinct()
    df = counts.join(F.broadcast(used), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(float(total + len(rows) + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    b = forms.join(df, "pair", "left").select("licence", "pair", idf.alias("idf"), (F.col("tf") * idf).alias("v"))
    sizes = b.groupBy("licence").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("size"))
    # Pairs that no template has only lengthen a vector: they weigh as if in no other text.
    idfs, rare = b.select("pair", "idf").distinct(), float(total + len(rows) + 1)
    a = counts.join(F.broadcast(idfs), "pair", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(rare) / 2) + 1))
    norms = a.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = a.join(F.broadcast(b.select("licence", "pair", "v")), "pair").groupBy("key", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, "key").join(F.broadcast(sizes), "licence").select("key", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 9).alias("score"))
    best = cosine.filter(F.col("score") >= least).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("m"))
    return keyed.select("path", "key").join(best, "key").groupBy("path").agg(F.min("m").alias("m")).select("path", F.col("m.licence").alias("licence"), (-F.col("m.minus")).alias("score"))


def header_lines(like: DataFrame) -> DataFrame:
    """path, chars (of the text), key (of the text) and line: the lines of (path, text) that speak of a licence."""
    lines = like.select("path", F.length("text").alias("chars"), F.xxhash64("text").alias("key"), F.explode(F.split("text", r"\R")).alias("line")).filter(F.col("line").rlike(HEADER))
    # A header may stand in a long line of prose: its sentence is compared, whatever letter the next one begins with, and of a
    # long sentence also the words round each header word. Only sentences that end before a capital count for a file's share.
    words = lambda s: F.split(s, r"\s+")
    plain, loose = F.split("line", r"(?<=[.!?;])\s+(?=[A-Z])"), F.split("line", r"(?<=[.!?;])\s+")
    near = F.flatten(F.transform(F.filter(loose, lambda s: s.rlike(HEADER) & (F.size(words(s)) > LONG_SENTENCE)), lambda s: _windows(words(s))))
    more = F.array_except(F.concat(loose, near), plain)
    parts = F.concat(_marked(plain, True), _marked(more, False))
    return lines.select("path", "chars", "key", F.explode(parts).alias("p")).select("path", "chars", "key", "p.line", "p.counts").filter(F.col("line").rlike(HEADER))


def _marked(parts: F.Column, counts: bool) -> F.Column:
    return F.transform(parts, lambda p: F.struct(p.alias("line"), F.lit(counts).alias("counts")))


def _windows(words: F.Column) -> F.Column:
    """The words from each header word, and from some before it, in the lengths that headers have."""
    cut = lambda i, back, n: F.array_join(F.slice(words, F.greatest(i + 1 - back, F.lit(1)), F.lit(n)), " ")
    near = F.transform(words, lambda w, i: F.when(w.rlike(HEADER_WORD), F.array(*[cut(i, back, n) for back in (0, 4) for n in WINDOWS])))
    return F.flatten(F.filter(near, lambda x: x.isNotNull()))


def header_matches(like: DataFrame, least: float = LEAST) -> DataFrame:
    """path, licence, score, is_file of the files with a header like a template; the best one, ties by licence name."""
    spark = like.sparkSession
    lines = staged(header_lines(like), "headers")
    rows = [(name, i, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    templates = spark.createDataFrame(rows, "licence string, form int, line string")
    # Equal lines are one vector.
    distinct = lines.groupBy("line").agg(F.count("*").alias("n"))
    counts = distinct.select("line", "n", F.explode(_words("line")).alias("word")).groupBy("line", "n", "word").agg(F.count("*").alias("tf"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = counts.groupBy("word").agg(F.sum("n").alias("df"))
    forms = templates.select("licence", "form", F.explode(_words("line")).alias("word")).groupBy("licence", "form", "word").agg(F.count("*").alias("tf"))
    idf = F.log(F.lit(float(total + len(rows) + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = lambda t: t.join(df, "word", "left").withColumn("w", F.col("tf") * idf)
    a, b = weighed(counts), weighed(forms).select("licence", "form", "word", F.col("w").alias("v"))
    norms = a.groupBy("line").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    sizes = b.groupBy("licence", "form").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("size"))
    dots = a.join(F.broadcast(b), "word").groupBy("line", "licence", "form").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, "line").join(F.broadcast(sizes), ["licence", "form"]).select("line", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 9).alias("score"))
    best = cosine.filter(F.col("score") >= least).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("m"))
    found = lines.join(best, "line").groupBy("path", "key").agg(F.min("m").alias("m"), (F.sum(F.when(F.col("counts"), F.length("line")).otherwise(0)) >= SHARE * F.max("chars")).alias("mostly"))
    found = found.groupBy("path").agg(F.min("m").alias("m"), F.max("mostly").alias("mostly"))
    return found.select("path", F.col("m.licence").alias("licence"), (-F.col("m.minus")).alias("score"), (F.col("mostly") | F.col("path").rlike(FILE_NAME)).alias("is_file"))


def parent(path) -> F.Column:
    """The directory of a path; that of the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """path, licence, score, source (own, inherited or none) and from_path of every file (path, text).

    Paths are expected to be unique: repeated rows count once and get the same result each; of several texts under a path
    the best match counts. Rows with a null path have no licence and pass none on. Null and empty texts have no licence of
    their own; lines are compared whole, however long. Of a directory's licence files the best-scoring counts, ties by path;
    the root directory's are everyone's.
    """
    texts = files.select("path", "text").filter(F.col("path").isNotNull() & F.col("text").rlike(LIKE))
    like = staged(texts.withColumn("key", F.xxhash64("text")).dropDuplicates(["path", "key"]).drop("key"), "licences")
    headers, whole = header_matches(like, least), whole_matches(like, least)
    # What a text is as a whole counts before its lines.
    found = headers.withColumn("level", F.lit(1)).unionByName(whole.withColumns({"is_file": F.lit(True), "level": F.lit(0)}))
    found = staged(found.groupBy("path").agg(F.min(F.struct("level", "licence", "score", "is_file")).alias("f")).select("path", "f.licence", "f.score", "f.is_file"), "found")
    given = found.filter("is_file").groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "licence")).alias("g"))
    dirs = files.filter("path is not null").select(parent(F.col("path")).alias("home")).distinct()
    steps = F.split("home", "/")
    above = dirs.select("home", F.explode(F.sequence(F.lit(0), F.when(F.col("home") == "", 0).otherwise(F.size(steps)))).alias("depth"))
    above = above.withColumn("dir", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(given, "dir").groupBy("home").agg(F.max_by("g", "depth").alias("g"))
    rows = files.select("path", parent(F.col("path")).alias("home")).join(found.drop("is_file"), "path", "left").join(nearest, "home", "left")
    own = F.col("licence").isNotNull()
    return rows.select(
        "path",
        F.coalesce("licence", "g.licence").alias("licence"),
        F.coalesce("score", -F.col("g.minus")).alias("score"),
        F.when(own, "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("source"),
        F.when(own, F.col("path")).otherwise(F.col("g.path")).alias("from_path"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over documents laid out as source/lang/doc_id; rows with a null id have no path and no licence."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    files = docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return scan(files).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "licence", "score", "source", "from_path")
