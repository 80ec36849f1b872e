"""Frontiers, nested maps, limits and the stream's gate, each against a plain loop."""

import heapq
import random
import time

import pandas as pd
import pytest
from compare import rows_of_frame, rows_of_sql
from pagemill.operators import frontier, limits
from pagemill.plans import catalogue
from pagemill.streaming import gates


def plain_expansion(edges, scores, seeds, budget, most_depth, per_round):
    known = {n: [0, None] for n in seeds}
    number = 0
    while len([1 for _, r in known.values() if r]) < budget:
        pending = [(-scores.get(n, 0.0), d, n) for n, (d, r) in known.items() if r is None]
        if not pending:
            break
        number += 1
        left = budget - len([1 for _, r in known.values() if r])
        taken = heapq.nsmallest(min(per_round, left), pending)
        found = {}
        for _, d, n in taken:
            known[n][1] = number
            if d < most_depth:
                for a, b in edges:
                    if a == n and b not in known:
                        found[b] = min(found.get(b, d + 1), d + 1)
        for n, d in found.items():
            known[n] = [d, None]
    return known


def graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [("n0", "n1")] * 3 + [("n0", x) for x in nodes[::3]]
    return edges, {n: float(rng.randrange(4)) for n in nodes[:30]}


@pytest.mark.parametrize(("seed", "budget", "depth", "per_round"), [(1, 12, 3, 4), (2, 1000, 2, 7), (4, 5, 0, 5)])
def test_expansion_equals_plain_rounds(spark, seed, budget, depth, per_round):
    edges, scores = graph(seed)
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([*scores.items(), ("n1", -1.0)], "node string, score double")
    roots = spark.createDataFrame([("n0",), ("n5",), ("n5",)], "node string")
    got = frontier.expand(e, s, roots, budget, depth, per_round)
    want = plain_expansion(edges, scores, ["n0", "n5"], budget, depth, per_round)
    assert {r["node"]: [r["depth"], r["round"]] for r in got.known.collect()} == want
    assert got.state == ("STOPPED" if any(r is None for _, r in want.values()) else "COMPLETED")
    assert got.visited == sum(r is not None for _, r in want.values()) <= budget


def test_resumed_after_whole_rounds_the_set_is_the_same(spark):
    edges, scores = graph(6)
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(scores.items()), "node string, score double")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(6)], "node string")
    half = frontier.expand(e, s, roots, 6, 4, 3)
    assert half.state == "STOPPED" and half.visited == 6
    rows = lambda x: sorted(map(tuple, x.known.select("node", "depth", "round").collect()), key=str)
    assert rows(frontier.expand(e, s, roots, 15, 4, 3, resume=half)) == rows(frontier.expand(e, s, roots, 15, 4, 3))


def test_nothing_to_expand(spark):
    none = frontier.expand(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string, score double"), spark.createDataFrame([], "node string"), 5, 2, 2)
    assert none.state == "COMPLETED" and none.visited == 0 and none.known.count() == 0


def plain_locations(files, roots, most_files, most_locations):
    import re

    queue, seen, out, read = list(roots), set(), [], 0
    while queue and read < most_files:
        name = queue.pop(0)
        if name in seen:
            continue
        seen.add(name)
        read += 1
        text = files.get(name, "")
        locations = re.findall(r"(?i)<loc>\s*([^<\s]+)\s*</loc>", text)
        if "<sitemapindex" in text.lower():
            queue += locations
        else:
            out += locations
    return list(dict.fromkeys(out))[:most_locations]


@pytest.mark.parametrize(("seed", "most_files", "most_locations"), [(1, 80, 20_000), (2, 5, 7), (5, 12, 30)])
def test_nested_maps_equal_a_plain_queue(spark, seed, most_files, most_locations):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(14)]
    loc = lambda x: f"<loc> {x}\n</LOC>"
    files = {n: ("<SitemapIndex>" + "".join(loc(rng.choice([*names, "gone"])) for _ in range(rng.randint(0, 5)))) if rng.random() < 0.5 else "".join(loc(f"u{rng.randrange(40)}") for _ in range(rng.randint(0, 9))) for n in names}
    files["f0"] = "<sitemapindex>" + "".join(loc(x) for x in ("f0", "f1", "gone", "f2", "f1", "f3"))
    files["f3"] = "<sitemapindex>" + "".join(loc(x) for x in ("f4", "f0", "f5"))
    roots = {"a": ["f0", "f9"], "b": ["f3", "f3"], "c": ["gone"]}
    rows = [(s, i, f) for s, found in roots.items() for i, f in enumerate(found)]
    got = frontier.nested_locations(spark.createDataFrame(list(files.items()), "file string, text string"), spark.createDataFrame(rows, "site string, place int, file string"), most_files, most_locations)
    by_site = {s: [] for s in roots}
    for r in sorted(got.collect(), key=lambda r: r["position"]):
        by_site[r["site"]].append(r["location"])
    assert by_site == {s: plain_locations(files, list(dict.fromkeys(found)), most_files, most_locations) for s, found in roots.items()}


def test_closure_lists_all_files_and_addresses(spark, tmp_path):
    """A site with more lists and more addresses than a reader's usual limits."""
    rows = [(i, f"https://a.org/b{i % 90}/{i}", "") for i in range(20_030)]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    got = rows_of_frame(catalogue.queries()["s16_sitemap_closure"](spark, str(tmp_path)))
    assert len(got[1]) == 20_030 and got == rows_of_sql(catalogue.oracle_sql()["s16_sitemap_closure"], str(tmp_path))


def plain_limit(events, gap, most, window):
    out, state = {}, {}
    for k, t, o in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        last, opened, used = state.get(k, (None, t, 0))
        if t - opened > window:
            opened, used = t, 0
        fine = used < most and (last is None or t - last >= gap)
        state[k] = (t, opened, used + 1) if fine else (last, opened, used)
        out[k, o] = fine
    return out


def test_limited_attempts_equal_a_plain_loop(spark):
    rng = random.Random(4)
    events = [(rng.choice([1, 2, 3, 3, 3, 3, None]), float(rng.randrange(4000)), i) for i in range(600)]
    rows = spark.createDataFrame([*events, (2, None, 900)], "k long, t double, o long").repartition(5)
    got = {(r["k"], r["o"]): r["allowed"] for r in limits.limited(rows, "k", "t", "o", 40, 5, 600).collect()}
    assert got.pop((2, 900)) is False
    assert got == plain_limit(events, 40, 5, 600) and 10 < sum(got.values()) < 400
    assert limits.limited(rows.limit(0), "k", "t", "o", 40, 5, 600).count() == 0


def pages(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([f"https://A.org/C/{2012 + rng.randrange(9)}/x{i % 3}?q=1", f"https://b.org/{1995 + rng.randrange(40)}/{2000 + rng.randrange(9)}", "https://b.org/plain"])) for i in range(n)]


def test_gate_on_a_stream_equals_the_batch_gate(spark, tmp_path):
    """Several micro-batches, a restart from the checkpoint between them."""
    rows, schema = pages(120), "page_id long, url string"

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = gates.admitted_stream(found).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        query = out.option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    feed(rows[:30])
    feed(rows[30:60])
    run()
    feed(rows[60:])
    run()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, gates.admitted(spark.createDataFrame(rows, schema)).collect()))
    assert got == want and len(got) > 8
    newest = {}
    for i, url in rows:  # the same, said plainly
        r = gates.editions(spark.createDataFrame([(i, url)], schema)).first() if i < 4 else None
        if r:
            newest[r["family"]] = max(newest.get(r["family"], 0), r["year"])
    assert all(any(g[0] == f for g in got) for f in newest)


def test_editions_take_the_newest_year(spark):
    rows = [(1, "https://A.org/Handbook/1999/2024/X"), (2, "https://a.org/handbook/2023/2021/x/"), (3, "https://a.org/2040/x"), (4, "not a url"), (5, "https://a.org/12024/x")]
    got = {r["page_id"]: (r["family"], r["year"]) for r in gates.editions(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("a.org/handbook/~year~/~year~/x", 2024), 2: ("a.org/handbook/~year~/~year~/x/", 2023)}


@pytest.mark.parametrize("name", ["x7_edition_gate", "x7_edition_stream"])
def test_gate_queries_take_the_first_year(spark, tmp_path, name):
    """The number of a page looks like a year and stays before the edition's, as the slash behind it keeps it."""
    rows = [(1, "https://a.org/en/2013/"), (2, "https://a.org/en/2016/"), (3, "https://a.org/en/2015/"), (4, "https://a.org/en/71"), (5, "https://a.org/en/1/")]
    pd.DataFrame([(*r, "") for r in rows], columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    got = rows_of_frame(catalogue.queries()[name](spark, str(tmp_path)))
    assert got == rows_of_sql(catalogue.oracle_sql()[name], str(tmp_path)) and any("2016" in r for r in got[1])


def test_families_are_forgotten(spark, tmp_path):
    """With a life of a millisecond a family's state is gone by the next batch, so an older edition passes again."""
    schema = "page_id long, url string"

    def years():
        files = list(tmp_path.glob("out/*.parquet"))
        return sorted(r["year"] for r in spark.read.schema(gates.ADMITTED).parquet(f"{tmp_path}/out").collect()) if files else []

    (tmp_path / "in").mkdir()
    found = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = gates.admitted_stream(found, forget_after_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query = out.option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for i, (year, want) in enumerate(((2020, [2020]), (2015, [2015, 2020]))):
            spark.createDataFrame([(i, f"https://a.org/c/{year}/x")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            deadline = time.monotonic() + 60
            while years() != want and time.monotonic() < deadline:
                time.sleep(0.5)
            assert years() == want
    finally:
        query.stop()


def test_edges_are_not_shuffled_each_round(spark, sf_dir):
    """Repeated edges change nothing, so each round reads the table without making its rows distinct."""
    from pagemill.plans import state_queries

    edges, _, _ = state_queries._graph(spark, sf_dir)
    assert not any(x in edges._jdf.queryExecution().analyzed().toString() for x in ("Distinct", "Deduplicate", "Aggregate"))
