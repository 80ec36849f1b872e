"""Relational queries: filters, joins, aggregates, windows, pages and set operations over the host tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators import relational as R


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_criteria_search(spark, sf_dir):
    """Conjunction of optional conditions with a search over several columns."""
    docs = _t(spark, sf_dir, "documents")
    return R.where(docs, {"lang": "en"}, {"n_chars": 200}, {"n_chars": 3000}, (("source", "text"), "%%%")).select("doc_id", "source", "n_chars")


def p5_null_safe_lists(spark, sf_dir):
    """NOT IN keeps rows without a value, and null states are told apart."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    kept = rows.filter(F.col("toxic").isNull() | ~F.col("toxic").isin(1))
    return kept.groupBy(F.col("toxic").isNull().alias("unlabelled")).agg(F.count("*").alias("n"))


def p7_status_ranges(spark, sf_dir):
    """Ranges, prefixes and retryable states on orders."""
    o = _t(spark, sf_dir, "orders")
    return o.filter(F.col("o_totalprice").between(50000, 100000) & F.col("o_orderpriority").like("1-%")).select("o_orderkey", "o_orderstatus")


def p19_scopes(spark, sf_dir):
    """Each export scope is a predicate; rows of every scope."""
    o = _t(spark, sf_dir, "orders")
    scopes = {"all": F.lit(True), "open": F.col("o_orderstatus") == "O", "finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") >= 200000}
    tagged = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))).alias("scope")
    return o.select(tagged, "o_orderkey").groupBy("scope").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def p20_export_gate(spark, sf_dir):
    """P20: labelled rows are included, excluded or flagged; the gate is shut if a good row is toxic."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    gate = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality").isNull(), "flagged").when(F.col("quality") == 1, "included").otherwise("excluded")
    return rows.groupBy(gate.alias("decision")).agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("shut_by"))


def p22_constraints(spark, sf_dir):
    """Which checks the rows of the pages fail."""
    p = _t(spark, sf_dir, "pages")
    bad = [F.when(~F.col("url").rlike("^https?://"), "url_format"), F.when(F.length(F.trim("html")) == 0, "empty"), F.when(F.col("url").contains("#"), "fragment")]
    return p.select(F.explode(F.array_compact(F.array(*bad))).alias("failed")).groupBy("failed").agg(F.count("*").alias("n"))


RULES = [("/", True), ("/en/", False), ("/en/1", True), ("/fr/8", False), ("/fr", True), ("/de/", False), ("/de/2", True)]


def p25_robots_longest_match(spark, sf_dir):
    """P25: of the rules that begin a path the longest decides, allow before disallow."""
    from pagemill.functions import urls

    rules = F.array(*[F.struct(F.lit(len(p)).alias("len"), F.lit(a).alias("allow"), F.lit(p).alias("p")) for p, a in RULES])
    u = _t(spark, sf_dir, "pages").select("page_id", urls.path(F.col("url")).alias("path"))
    best = F.array_max(F.filter(rules, lambda r: F.startswith(F.col("path"), r["p"])))
    return u.select("page_id", "path", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def j1_feed_join(spark, sf_dir):
    """The newest orders with the names of their customer and nation."""
    o = _t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


def j2_best_child(spark, sf_dir):
    """Of each order its dearest line, and the line numbers of the five dearest."""
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    top = R.first_of_group(line, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 5)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("m"), F.col("l_linenumber").alias("n"))))
    rows = top.groupBy("l_orderkey").agg(ranked.alias("r"))
    out = rows.select("l_orderkey", F.col("r")[0]["n"].alias("best_line"), F.array_join(F.transform("r", lambda s: s["n"].cast("string")), ",").alias("top_lines"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(out, "l_orderkey", "left")


def j5_having_pending(spark, sf_dir):
    """Customers with more than five open orders."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    n = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_orders")).filter("open_orders > 5")
    return n.join(c, n.o_custkey == c.c_custkey).select("c_custkey", "c_name", "open_orders")


def j11_override_precedence(spark, sf_dir):
    """A label decides before the source's majority, and that before the default."""
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    by_source = d.join(lab, "doc_id").groupBy("source").agg((F.avg("quality") >= 0.8).alias("mostly"))
    rows = d.select("doc_id", "source").join(lab, "doc_id", "left").join(by_source, "source", "left")
    status = F.when(F.col("quality").isNotNull(), F.when(F.col("quality") == 1, "FOUND").otherwise("NOT_FOUND")).when(F.col("mostly"), "SHARED").otherwise("NEEDS_REVIEW")
    origin = F.when(F.col("quality").isNotNull(), "label").when(F.col("mostly").isNotNull(), "source").otherwise("default")
    return rows.select("doc_id", status.alias("status"), origin.alias("decided_by"))


def j13_prefix_join(spark, sf_dir):
    """Per branch of a host its pages' paths as ordered text. The prefix is a key, so the join is on equality."""
    from pagemill.functions import urls

    u = F.col("url")
    p = _t(spark, sf_dir, "pages").select(urls.registrable_domain(urls.host(u)).alias("domain"), urls.branch(u).alias("branch"), urls.path(u).alias("path"))
    stems = p.select("domain", "branch").distinct()
    found = stems.join(p, ["domain", "branch"]).filter(F.startswith("path", F.concat(F.lit("/"), F.col("branch"))))
    return found.groupBy("domain", "branch").agg(F.array_join(F.sort_array(F.collect_set("path")), "\n").alias("children"))


PLAIN_WORDS = ("the", "of", "university", "and")


def j17_name_match(spark, sf_dir):
    """Names match where their distinctive words are the same set, or, where one has a single such word, if the other has it.

    Every supplier and customer with its name's words, the names of the other side that match them and how many rows those
    stand for; names of the same words are one name, so links are told between names and no pairs of rows are spread out. Sets
    of two words or more meet on the whole set, single words on the word.
    """
    distinctive = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*PLAIN_WORDS))))
    n, s, c = (_t(spark, sf_dir, x) for x in ("nation", "supplier", "customer"))
    k, code = F.col("s_suppkey") % 3, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    named = F.when(k == 0, F.concat(F.lit("The University of "), code)).when(k == 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(" and "), code)).otherwise(F.concat(code, F.lit(" r9")))
    own = F.concat(F.lit("University of N"), F.col("c_nationkey").cast("string"), F.lit(", R"), F.col("n_regionkey").cast("string"))
    suppliers = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("id"), distinctive(named).alias("words"))
    customers = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"), distinctive(own).alias("words"))
    a = suppliers.groupBy(F.col("words").alias("x")).agg(F.count("*").alias("suppliers"))
    b = customers.groupBy(F.col("words").alias("y")).agg(F.count("*").alias("customers"))
    same = a.filter(F.size("x") > 1).join(b.filter(F.size("y") > 1), F.col("x") == F.col("y")).select("x", "y", "suppliers", "customers")
    part = a.filter(F.size("x") == 1).withColumn("word", F.col("x")[0]).join(b.withColumn("word", F.explode("y")), "word").select("x", "y", "suppliers", "customers")
    back = b.filter(F.size("y") == 1).withColumn("word", F.col("y")[0]).join(a.filter(F.size("x") > 1).withColumn("word", F.explode("x")), "word").select("x", "y", "suppliers", "customers")
    pairs = same.unionByName(part).unionByName(back)
    side = lambda name, words, other, rows: pairs.groupBy(F.lit(name).alias("side"), F.col(words).alias("words")).agg(
        F.array_join(F.array_sort(F.collect_list(F.array_join(other, " "))), "; ").alias("matches"), F.sum(rows).alias("links")
    )
    found = side("supplier", "x", "y", "customers").unionByName(side("customer", "y", "x", "suppliers"))
    rows = suppliers.unionByName(customers).join(F.broadcast(found), ["side", "words"], "left")
    return rows.select("side", "id", F.array_join("words", " ").alias("name"), F.coalesce("matches", F.lit("")).alias("matches"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def j19_frontier_anti(spark, sf_dir):
    """Pages still to do: neither their URL nor its canonical form is done."""
    from pagemill.functions import urls

    p = _t(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))
    done = p.filter("page_id % 3 = 0").select(F.explode(F.array("url", "canonical")).alias("alias")).distinct()
    waiting = p.join(done, F.col("url") == F.col("alias"), "left_anti").join(done, F.col("canonical") == F.col("alias"), "left_anti")
    return waiting.select("page_id", "canonical")


def a3_recount(spark, sf_dir):
    """A1 A3: per customer the orders, the finished ones and the distinct parts, zero for none."""
    o, line = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    parts = o.select("o_orderkey", "o_custkey").join(line.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = parts.groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("parts"))
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    rows = c.join(n, c.c_custkey == n.o_custkey, "left").drop("o_custkey").join(parts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("orders", "finished", "parts")])


def a2_status_counts(spark, sf_dir):
    """Counts by two keys, with each key's share of its group."""
    o = _t(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return o.withColumn("of_priority", F.sum("n").over(Window.partitionBy("o_orderpriority")))


def a6_filter_aggs(spark, sf_dir):
    """Filtered aggregates, averages of counts and the newest time stamp in one row."""
    e = _t(spark, sf_dir, "events")
    one = e.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("avg_purchase"))
    per = e.groupBy("user_id").agg(F.count("*").alias("c")).agg(F.round(F.avg("c"), 6).alias("avg_events"))
    return one.join(F.broadcast(per), F.lit(True))


def a8_weighted_remaining(spark, sf_dir):
    """Open orders count whole, urgent small ones 0.35, by customer segment."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    low = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000)
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.count_if(low).alias("low"))
    return rows.withColumn("remaining", F.round(F.col("queued") + F.col("low") * 0.35, 2))


def a9_trailing_rates(spark, sf_dir):
    """Events of the last 10 days by type, per day, and their share."""
    e = R.trailing(_t(spark, sf_dir, "events"), "ts", "10 days")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / 10, 4).alias("per_day"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def a12_summary_rollup(spark, sf_dir):
    """Conditional counts by nation and in all."""
    c, n, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "orders")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.with_total(rows, "n_name", [F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large")])


def a13_coverage_status(spark, sf_dir):
    """Per source the labelled and good documents, the coverage state and a LOW flag."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    g = rows.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    state = F.when(F.col("labelled") == 0, "NO_DATA").when(F.col("labelled") == F.col("total"), "COMPLETE").otherwise("INCOMPLETE")
    return g.withColumn("state", state).withColumn("low", (F.col("total") >= 30) & (F.col("good") / F.col("total") < 0.35))


def a15_distinct_keys(spark, sf_dir):
    """Headline counts with distinct hosts and domains, by scheme."""
    from pagemill.functions import urls

    u = F.col("url")
    return _t(spark, sf_dir, "pages").groupBy(urls.scheme(u).alias("scheme")).agg(
        F.count("*").alias("pages"), F.count_distinct(urls.host(u)).alias("hosts"), F.count_distinct(urls.registrable_domain(urls.host(u))).alias("domains")
    )


def a22_funnel(spark, sf_dir):
    """Per nation customers, buyers, orders and lines."""
    c, o, line, n = (_t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "nation"))
    lines = line.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    per = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    rows = c.join(per, c.c_custkey == per.o_custkey, "left").groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.count("orders").alias("buyers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    )
    return rows.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "buyers", "orders", "lines")


def a26_dataset_hash(spark, sf_dir):
    """A hash of the nations that doesn't depend on the rows' order."""
    return R.dataset_hash(_t(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def t1_keyset_page(spark, sf_dir):
    """The second page of orders by date and key, and whether a third follows."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = R.keyset_page(o, ["o_orderdate", "o_orderkey"], None, 50).collect()[49]
    page = R.keyset_page(o, ["o_orderdate", "o_orderkey"], (last["o_orderdate"], last["o_orderkey"]), 50)
    place = F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return page.withColumn("place", place).filter("place <= 50").withColumn("place", F.col("place").cast("long")).withColumn("has_more", F.lit(page.count() > 50))


def t4_tiers(spark, sf_dir):
    """Orders in three tiers, the first 100 by tier and key."""
    tier = F.when(F.col("o_totalprice") >= 250000, 0).when(F.col("o_totalprice") >= 100000, 1).otherwise(2)
    return _t(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier")).orderBy("tier", "o_orderkey").limit(100)


def u1_union_levels(spark, sf_dir):
    """Customers and suppliers as one list, by level and name."""
    c = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("level"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = _t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("level"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.unionByName(s).join(F.broadcast(n), F.col("nation") == F.col("n_nationkey")).select("level", "name", "n_name")


def u2_vocabulary(spark, sf_dir):
    """The merged vocabulary: trimmed, lower case, distinct, without blanks."""
    a = _t(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("w"))
    b = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return a.union(b).select(F.lower(F.trim("w")).alias("word")).filter("word != ''").distinct()


def u3_except_keys(spark, sf_dir):
    """Customers of the earlier half of orders that the later half lacks, the first 100."""
    o = _t(spark, sf_dir, "orders")
    return R.missing_from(o.filter("o_orderkey % 2 = 0").select("o_custkey").distinct(), o.filter("o_orderkey % 2 = 1").select("o_custkey"), ["o_custkey"]).orderBy("o_custkey").limit(100)


def w3_running_index(spark, sf_dir):
    """Turns numbered in their conversation, whether a user has spoken before, and the last turn's mark."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf_dir, "conversations")
    return t.select(
        "conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("chunk_index"),
        F.coalesce(F.max(F.col("role") == "user").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("user_before"),
        (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1).alias("is_last"),
    )


def w6_rate_delta(spark, sf_dir):
    """Events in 30-minute buckets and the change from the bucket before."""
    e = _t(spark, sf_dir, "events").groupBy((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800) * 1800).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    day = F.floor(F.col("bucket") / 86400)
    return e.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy(day).orderBy("bucket")))


def w5_miss_counter(spark, sf_dir):
    """Per user the consecutive days without a purchase, up to each day with events."""
    e = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.col("event_type") == "purchase").alias("hit"))
    w = Window.partitionBy("user_id").orderBy("day")
    runs = e.withColumn("island", F.count_if("hit").over(w))
    misses = F.count_if(~F.col("hit")).over(Window.partitionBy("user_id", "island").orderBy("day"))
    return runs.select("user_id", "day", misses.alias("misses"))


def k12_upsert(spark, sf_dir):
    """Customers merged with a changed and a new batch."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return R.upsert(c, changed, ["c_custkey"], ["c_mktsegment"])


def x4_reachability(spark, sf_dir):
    """Least depth from the nations of region 0 over nation, customer, order and part, up to depth 3."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    c, o, line, n = (_t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "nation"))
    edges = (
        c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))
        .union(o.select(key("c", "o_custkey"), key("o", "o_orderkey")))
        .union(line.select(key("o", "l_orderkey"), key("p", "l_partkey")).distinct())
    )
    from pagemill.operators.graph import reach

    seen = reach(edges, n.filter("n_regionkey = 0").select(key("n", "n_nationkey").alias("node")), 3)
    return seen.groupBy("depth", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_criteria_search, p5_null_safe_lists, p7_status_ranges, p19_scopes, p20_export_gate, p22_constraints, p25_robots_longest_match, j1_feed_join,
        j2_best_child, j5_having_pending, j11_override_precedence, j13_prefix_join, j17_name_match, j19_frontier_anti, a2_status_counts, a3_recount,
        a6_filter_aggs, a8_weighted_remaining, a9_trailing_rates, a12_summary_rollup, a13_coverage_status, a15_distinct_keys, a22_funnel, a26_dataset_hash,
        t1_keyset_page, t4_tiers, u1_union_levels, u2_vocabulary, u3_except_keys, w3_running_index, w5_miss_counter, w6_rate_delta, k12_upsert, x4_reachability,
    )
}
