"""Steps that grew faster than their input, or gave other rows than their SQL on larger tables."""

import os

import pytest

from marketspark.operators import dom
from marketspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
HTML = '<html><body class="x y"><div><h3>A</h3><p class="price">$1<p>two</div><script type="a/b">{"a": 1}</script><ul><li>one<li>two</ul><a href="/x" download>t</a></body></html>'


@pytest.mark.parametrize("html", [HTML, HTML + "<br>", "<p>a &amp; b", "<p>x<!-- c -->y", "<script>a<b</script><p>z", "<script>open", "<title>t<p></title>", "text < more", "<A HREF='x'>y</A>", "<i a=1>", "<img/>", ""])
def test_plain_html_reads_as_the_parser_reads_it(html):
    read, fed = dom._Nodes(), dom._Nodes()
    read.read(html)
    fed.feed(html)
    fed.close()
    assert read.rows == fed.rows


def test_wanted_nodes_are_those_of_the_whole_page(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<p>a &amp; b<li>c"), (3, None)], "page_id long, html string")
    every = dom.nodes(pages).where("tag in ('li', 'a') or map_contains_key(attrs, 'class')").collect()
    some = dom.nodes(pages, tags=("li", "a"), attrs=("class",)).collect()
    assert sorted(map(repr, every)) == sorted(map(repr, some)) and len(some) == 6


LINE = "<tr> <td>a<td>$1</td> <th>c</tr>"


@pytest.mark.parametrize("html", [
    f"<h2>x</h2><table>{LINE * 3}</table><p class='y'>z", f'<h2>x</h2><table>{LINE * 3} and {LINE}</table><p class="y">z', f"<p>q{LINE}r</p>", f"<tr><td>{LINE}<p>u</td><h2>v", f"<th>{LINE}<h2>v",
    f"<table>{LINE}<tr><td><table>{LINE * 2}</table><h2>in</h2></table><h2>out", f"<script>{LINE}</script><h2>x", f"{LINE * 2}<tr><td>&amp;</tr><h2>x", f"<h2>{LINE}</h2>", f"<li>a<table>{LINE}</table><li>b",
])
def test_table_rows_that_nobody_wants_change_nothing(html):
    """Before, each of their cells went through the reader one by one, most of a page's time."""
    wanted = lambda tag, said: tag in ("h2", "p", "table", "li") or "class" in said
    read, fed = dom._Nodes(wanted), dom._Nodes(wanted)
    read.read(html)
    fed.feed(html)
    fed.close()
    kept = lambda p: [(r[0], r[1], r[2], r[3], "".join(r[4]), p.up(r)) for r in p.rows if r is not None and r[4] is not None]
    assert kept(read) == kept(fed) and len(read.rows) == len(fed.rows)


def test_table_rows_are_passed_at_once():
    p = dom._Nodes(lambda tag, said: tag == "h2")
    p.handle_data = lambda data: None
    starts = []
    handle, p.handle_starttag = p.handle_starttag, lambda tag, attrs: (starts.append(tag), handle(tag, attrs))
    p.read(f"<h2></h2><table>{LINE * 500}</table><h2></h2>")
    assert starts == ["h2", "table", "h2"] and [r[0] for r in p.rows if r] == [0, 1, 2002]


def test_lines_of_tables_are_read_with_their_heads(spark):
    """Bare rows and others, heads in several rows and within lines, cells that are missing, tables in tables, text after cells."""
    from marketspark.plans.extraction import services_of

    head = "<tr><th>Service<th>Price<th>Category</tr>"
    pages = [
        (1, f"<table>{head}<tr><td> a  b <td>$1.50<td>c</tr><tr><td>d</td> <td>$2</td></tr></table>"),
        (2, f"<table>{head}<tr><td>e &amp; f<td><b>$3</b> net<td>g</tr><tr><td>h<td><table><tr><th>Item</tr><tr><td>in</tr></table><td>i</tr></table>"),
        (3, "<table><tr><td>no heads</tr></table><p><tr><td>no table</tr>"),
        (4, "<table><tr><th>Name<th>Note<th>Type</tr><tr><th>Old name<th>Cost</tr><tr><td>j<td>4<td>k</tr><tr><th>l<td>5</tr></table>"),
        (5, f"<script>{head}</script><table>{head}<tr class='x'><td>m<td>6<td>n</tr><tr><td>o</th>p<td>7<td>q</tr><!-- c --></table>"),
        (6, None),
    ]
    df = spark.createDataFrame(pages, "competitor_id long, html string")
    got = sorted(map(tuple, services_of(dom.tables(df, "competitor_id")).collect()), key=repr)
    want = [(1, "a b", "c", 1.5), (1, "d", None, 2.0), (2, "e & f", "g", 3.0), (2, "h", "i", None), (2, "in", None, None), (4, "j", "k", 4.0), (4, None, None, 5.0), (5, "m", "n", 6.0), (5, "op", "q", 7.0)]
    assert got == sorted(want, key=repr)


@data
def test_tables_need_no_shuffle_of_cells(spark):
    """Before, each cell was a row that a window, a join and a grouping dealt out by page."""
    plan = QUERIES["extraction_tables"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and not any(x in plan[: plan.index("MapInArrow")] for x in ("Aggregate", "Join", "Repartition"))


@data
def test_metadata_writes_pages_once(spark):
    """Before, the canonical address was read from pages written a second time."""
    plan = QUERIES["extraction_metadata"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


@data
def test_pages_are_parsed_once_a_query(spark):
    """Before, each use of the nodes wrote and parsed all pages again."""
    for name, most in (("extraction_forms", 0), ("relationship_links", 0), ("extraction_cards", 0), ("extraction_locations", 0), ("extraction_contributions", 2)):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("MapInPandas") <= most, name


def test_references_without_a_semicolon_stay(spark):
    """The SQL of typed_blocks, typed_segments and merged_findings takes them as text (cut-off pages end in them)."""
    html = '<p>a &amp; b &amp</p><script>x && "&copy"</script><p>&&amp;& &copy'
    rows = dom.tree(spark.createDataFrame([(1, html)], "page_id long, html string")).where("tag like '#%' and text != ''").orderBy("node").collect()
    assert [r.text for r in rows] == ["a & b &amp", 'x && "&copy"', "&&& &copy"]


def test_pages_of_one_url_are_told_apart(spark, tmp_path):
    rows = [(k, "http://a/", h) for k, h in ((1, "x"), (2, "y"), (3, "z"), (4, "z"), (5, "x"), (6, None))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.state for r in QUERIES["incremental_skip"](spark, str(tmp_path)).collect()}
    assert got == {1: "unchanged", 2: "unchanged", 3: "unchanged", 4: "changed", 5: "new", 6: "changed"}


def test_days_are_summed_exactly(spark, tmp_path):
    """Three clicks make 0.3, as the SQL's decimals do, whatever the order; a symmetric series has no slope at all."""
    from pyspark.sql import functions as F

    from marketspark.operators import series as S
    from marketspark.plans.timeseries import composite

    rows = [(k, "2024-01-05 00:00:00", 1, "click", 1.0, "{}") for k in range(3)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert composite(spark, str(tmp_path)).agg(F.max("value")).first()[0] == 0.3
    one = spark.sql("select array(1d, 2d, 4d) as v, array(1d, 2d, 2d, 1d) as w").select(S.co_moment(F.col("v")), S.co_moment(F.col("w"))).first()
    assert one[0] == 3.0 and abs(one[1]) < 1e-12


def test_forecasts_compute_a_line_once(spark):
    """A slope inside a lambda was computed anew for each value of the series."""
    from pyspark.sql import functions as F

    from marketspark.operators import forecast as M

    plan = spark.sql("select array(1d, 2d) as v").select(M.intervals("linear_regression", F.col("v"), 7))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000


def test_pairs_that_share_groups_are_not_shuffled(spark):
    """Before, a row a pair and group was shuffled beyond 20,000 members, and pairs once more against the linked ones."""
    from itertools import combinations

    from marketspark.operators import graph as G

    groups = {k: {g for g in range(130) if (k * 7 + g * g) % 11 == 0 or g == k} for k in range(60)}
    groups[60] = {500}
    members = spark.createDataFrame([(k, str(g)) for k, gs in groups.items() for g in gs], "member long, grp string")
    links = [(1, 2), (3, 40), (12, 23)]
    want = {(a, b): len(groups[a] & groups[b]) for a, b in combinations(groups, 2) if groups[a] & groups[b]}
    assert {(r.a, r.b): r.shared for r in G.sharing(members).collect()} == want
    df = G.sharing(members, spark.createDataFrame(links, "src long, dst long"))
    assert {(r.a, r.b): r.shared for r in df.collect()} == {p: n for p, n in want.items() if p not in links}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@data
def test_keys_of_few_rows_are_not_counted_by_range(spark, monkeypatch):
    """Before, every row of every key went through a count by range and a checkpoint, a group a row."""
    from marketspark.operators import selection

    kept = []
    monkeypatch.setattr(selection, "cut", lambda df: kept.append(df.columns) or df)
    rows = spark.range(2000).selectExpr("id % 100 as k", "cast(id * 7 % 31 as double) as v")
    assert selection.quantiles(rows, ["k"], "v", 0.5).count() == 100
    assert len(kept) == 1


def test_links_are_arrays_that_no_pair_row_makes(spark, monkeypatch):
    """Before, a row a pair and service was shuffled, and every round of influence shuffled all edges again."""
    from itertools import combinations

    from marketspark.operators import graph as G

    groups = {0: range(300), 5: range(250, 260), 9000: [7, 400, 3], 9001: [3, 7], -4: [500], 9002: range(255, 257)}
    members = spark.createDataFrame([(m, g) for g, ms in groups.items() for m in ms], "member long, grp long")
    want = {p for ms in groups.values() for p in combinations(sorted(ms), 2)}
    rows = G.linked(members).collect()
    got = [(r.src, x) for r in rows for x in r.dsts]
    assert set(got) == want and len(got) == len(want) and len({r.src for r in rows}) == len(rows)
    cut, kept = G.cut, []
    monkeypatch.setattr(G, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    scores = {r.node: r.score for r in G.influence(G.linked(members)).collect()}
    assert kept[0].count() == len(rows) < len(want)
    pairs = spark.createDataFrame(sorted(want), "src long, dst long")
    assert {r.node: round(r.score, 12) for r in G.influence(pairs).collect()} == {k: round(v, 12) for k, v in scores.items()}


def test_alike_pairs_are_not_shuffled(spark):
    """Before, every candidate pair went with both its token sets through an exchange that dropped repeated ones; copies of a name
    were candidates one by one."""
    from itertools import combinations

    from marketspark.operators import matching as M

    sets = {f"c{k:03}": {"x", "y", "z"} for k in range(150)} | {f"n{k}": {"x", "y", "z", f"w{k % 3}"} for k in range(9)} | {"one": {"x"}, "lone": {"q"}, "far": {"w0", "w1", "v"}}
    rows = spark.createDataFrame([(n, sorted(t)) for n, t in sets.items()], "name string, tokens array<string>")
    df = M.alike(rows, [], 0.55)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]

    def like(a, b):
        n = len(a & b)
        return max(n / len(a | b), 0.9 * n / len(a)) if n >= 0.8 * len(a) and len(a) != len(b) else n / len(a | b)

    order = sorted(sets, key=lambda n: (len(sets[n]), n))
    want = {(a, b): round(s, 9) for a, b in combinations(order, 2) if (s := like(sets[a], sets[b])) >= 0.55}
    got = df.collect()
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want)


def test_relations_match_different_texts_once(spark, monkeypatch):
    """Before, each page's texts were cut into grams and matched by themselves, however many pages had the same ones."""
    from marketspark.operators import matching as M

    plain, seen = M.contained, []
    monkeypatch.setattr(M, "contained", lambda texts, names, keys: (seen.append(texts.distinct().count() + names.distinct().count()), plain(texts, names, keys))[1])
    page = [("service", "Red Bolt", "Red Bolt x"), ("service", "bolt", "bolt"), ("pricing", "red bolt", "red bolt"), ("offer", "o", "Save on RED BOLT"), ("plan", "P", "P"), ("plan_feature", "P", "gear plus"), ("feature", "gear", "gear"), ("plan_feature", "", ""), ("feature", "", "")]
    rows = lambda n: [(k, *e) for k in range(n) for e in page] + [(-1, "offer", "o", "Save on red bolt"), (-1, "service", "gear", None)]
    want = {("service", "Red Bolt", "pricing", "red bolt", "has_price", 0.6), ("service", "Red Bolt", "offer", "o", "has_offer", 0.7), ("service", "bolt", "offer", "o", "has_offer", 0.7), ("plan", "P", "feature", "gear", "has_feature", 0.55), ("plan", "", "feature", "", "has_feature", 0.95)}
    for n in (2, 20):
        got = M.relations(spark.createDataFrame(rows(n), "k int, kind string, name string, text string"), ["k"]).collect()
        assert len(got) == n * len(want) and {tuple(r) for r in got} == {(k, *w) for k in range(n) for w in want}
    assert seen[: len(seen) // 2] == seen[len(seen) // 2 :] and seen
