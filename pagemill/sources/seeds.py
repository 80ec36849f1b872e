"""Sources of seeds and state: spreadsheets with free headers, exports, robots files, sitemaps, JSON state, logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a header says about its column, first rule first; words within or the whole of the squeezed header.
ROLES = (
    ("country", ("country",), ("nation",)),
    ("base_url", ("url", "website", "weblink", "webaddress", "homepage", "domain"), ("web", "site", "link")),
    ("notes", ("note", "remark", "comment"), ()),
    ("name", ("name", "university", "college", "institution", "school"), ("uni",)),
)


def role_of(header: str | None) -> str:
    squeezed = re.sub(r"[^a-z0-9]", "", (header or "").lower())
    return next((role for role, within, whole in ROLES if squeezed and (squeezed in whole or any(w in squeezed for w in within))), "")


def most_name_like(rows: DataFrame, columns: list[str]) -> str | None:
    """Of columns without a telling header the one with long, alphabetic values, by its first 30 rows."""
    alpha = lambda c: F.col(c).rlike("(?i)[a-z]{3,}").cast("double")
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    head = rows.limit(30).agg(*[(F.avg(F.when(full(c), F.length(F.trim(c)))) * F.avg(F.when(full(c), alpha(c)))).alias(c) for c in columns]).first()
    best = max(((head[c] or 0.0, -i, c) for i, c in enumerate(columns)), default=(0.0, 0, None))
    return best[2] if best[0] > 0 else None


def with_roles(rows: DataFrame) -> DataFrame:
    """name, country, base_url, notes of a table with free headers; a role that no column plays is null."""
    found: dict[str, str] = {}
    for c in rows.columns:
        found.setdefault(role_of(c), c)
    if "name" not in found and (guess := most_name_like(rows, [c for c in rows.columns if c not in found.values() or role_of(c) == ""])):
        found["name"] = guess
    pick = lambda r: F.nullif(F.trim(F.col(f"`{found[r]}`").cast("string")), F.lit("")) if r in found else F.lit(None).cast("string")
    return rows.select(*[pick(r).alias(r) for r in ("name", "country", "base_url", "notes")])


def read_seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows (with their fault) of a CSV file with any headers; quotes may span lines."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return split_seeds(with_roles(raw))


def split_seeds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    url = F.when(F.col("base_url").rlike("(?i)^https?://"), F.col("base_url")).otherwise(F.concat(F.lit("https://"), F.col("base_url")))
    fault = F.when(F.col("name").isNull(), "no name").when(F.col("base_url").isNull(), "no address").when(~url.rlike(r"^[A-Za-z]+://[^/\s]+\.[^/\s]+"), "no address")
    marked = rows.withColumn("base_url", url).withColumn("fault", fault)
    return marked.filter("fault is null").drop("fault"), marked.filter("fault is not null")


def first_filled(df: DataFrame, pattern: str) -> F.Column:
    """The first non-empty value among the columns whose name matches."""
    found = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns if re.search(pattern, c, re.I)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def robots_rules(files: DataFrame) -> DataFrame:
    """host, allow, rule, position of robots files (host, text): only groups for all agents count.

    A file's lines are numbered; a run of agent lines opens a group, and every rule belongs to the last group opened.
    """
    from pyspark.sql import Window

    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("position", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("host", "position", F.lower(F.regexp_extract(clean, r"^([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract(clean, r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value")).filter("key != ''")
    w = Window.partitionBy("host").orderBy("position")
    opens = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(w) != "user-agent", F.lit(True))
    grouped = lines.withColumn("opens", opens).withColumn("group", F.count_if("opens").over(w))
    star = F.max((F.col("key") == "user-agent") & (F.col("value") == "*")).over(Window.partitionBy("host", "group"))
    rules = grouped.withColumn("star", star).filter(F.col("star") & F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("rule"), "position")


def rule_pattern(rule: F.Column) -> F.Column:
    """A rule as a pattern: * is anything, $ at its end is the path's end."""
    plain = F.regexp_replace(rule, r"([.+?^{}()|\[\]\\$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\\\$$", r"\$"))


def robots_decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, allowed: the longest matching rule decides, allow before disallow; no rule allows."""
    met = paths.join(rules, "host", "left").filter(F.col("rule").isNull() | F.rlike("path", rule_pattern(F.col("rule"))))
    best = met.groupBy("host", "path").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "allow"))).alias("best"))
    return paths.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def sitemap_locations(files: DataFrame) -> DataFrame:
    """file, location, is_index of sitemap files (file, text)."""
    found = F.explode(F.expr(r"regexp_extract_all(text, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)")).alias("location")
    kinds = files.select("file", "text", F.col("text").contains("<sitemapindex").alias("is_index"))  # once a file, not once a location
    return kinds.select("file", found, "is_index")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a JSON state document, one a line; broken ones are left out, and where there is no document there are no rows."""
    try:
        lines = spark.read.text(path).filter("trim(value) != ''")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    record = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return lines.select(record.alias("r")).select("r.*").filter("_broken is null").drop("_broken")


def log_counts(lines: DataFrame, words: list[str]) -> DataFrame:
    """Of log lines (value) how many have each word."""
    return lines.select(F.explode(F.array_compact(F.array(*[F.when(F.lower("value").contains(w.lower()), F.lit(w)) for w in words]))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def by_alias(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their roles: of each role the first non-empty value among its aliases, in their order; null for none."""
    squeezed = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in rows.columns}
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    found = {role: [filled(squeezed[a]) for a in names if a in squeezed] for role, names in aliases.items()}
    return rows.select(*[(F.coalesce(*cols) if cols else F.lit(None).cast("string")).alias(role) for role, cols in found.items()])


def json_items(texts: F.Column, schema: str) -> F.Column:
    """The items of a JSON array; a text that is none gives no items."""
    return F.coalesce(F.from_json(texts, f"array<struct<{schema}>>"), F.array().cast(f"array<struct<{schema}>>"))


def progress(lines: DataFrame, task: str, order: str, line: str) -> DataFrame:
    """Of each task's log the last mark "done/total" that can be one (0 < total, done <= total)."""
    marks = lines.select(task, order, F.expr(rf"regexp_extract({line}, '(?:^|[^0-9A-Za-z_])([0-9]+)\\s*/\\s*([0-9]+)', 1)").alias("d"), F.expr(rf"regexp_extract({line}, '(?:^|[^0-9A-Za-z_])([0-9]+)\\s*/\\s*([0-9]+)', 2)").alias("t"))
    marks = marks.filter("d != ''").select(task, order, F.col("d").cast("long").alias("done"), F.col("t").cast("long").alias("total")).filter("total > 0 and done <= total")
    return marks.groupBy(task).agg(F.max_by(F.struct("done", "total"), order).alias("m")).select(task, "m.done", "m.total")
