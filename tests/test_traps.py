"""Decisions on the surprising semantics that the inventory lists (README has the table), and plain versions of what SQL cannot
say: hash embeddings and hybrid search."""

import datetime
import hashlib
import io
import json
import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from marketspark.functions.price import currency, price
from marketspark.functions.text import content_hash, entity_key
from marketspark.functions.urls import canonical_link, is_tracking, social_handle
from marketspark.operators import documents, dom, forecast, graph, relational, retrieval, series
from marketspark.plans.intelligence import horizon_days
from marketspark.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_b1_snapshots_differ_both_ways(spark):
    a, b = (spark.createDataFrame(r, "k int, v int") for r in ([(1, 1), (2, 2), (3, 3)], [(2, 2), (3, 4), (5, 5)]))
    assert {tuple(r) for r in relational.snapshot_diff(a, b, "k", ["v"]).select("k", "change").collect()} == {(1, "removed"), (3, "modified"), (5, "added")}


def test_b2_dormant_is_counted_from_the_parents(spark):
    c, r = spark.createDataFrame([(1,), (2,)], "c int"), spark.createDataFrame([(1, 5)], "c int, runs int")
    assert c.join(r, "c", "left").where("runs is null").count() == 1


def test_b8_models_go_by_their_names():
    assert {"croston", "sba"} <= set(forecast.MODELS) and forecast.MODELS["heuristic"] is not forecast.MODELS["linear_regression"]


def test_b11_every_service_has_its_edge(spark):
    e = spark.createDataFrame([("offers", 1, 7), ("offers", 1, 8), ("in", 1, 3), ("offers", 2, 7)], "rel string, src long, dst long")
    assert sorted(r.node for r in graph.neighbors(e, 1, rel="offers").collect()) == [7, 8]
    assert sorted(r.node for r in graph.neighbors(e, 7, reverse=True).collect()) == [1, 2]


def test_b13_hash_embedding(spark):
    text = "Pest Control é"
    h = hashlib.sha512(text.lower().encode()).digest()
    raw = [int.from_bytes(h[i : i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(0, 64, 4)]
    norm = math.sqrt(sum(x * x for x in raw))
    got = one(spark, retrieval.hash_embedding(F.col("t")), t=text)
    assert len(got) == 128 and got[16:] == [0.0] * 112 and max(abs(a - b / norm) for a, b in zip(got, raw, strict=False)) < 1e-9


def test_hybrid_search_against_plain_scores(spark):
    texts = ["the red gear and ring", "blue bolt", "which gear is the best gear", "", "ring ring ring"]
    index = retrieval.chunks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "note", "id", "text")
    query = "which red gear"

    def unit(t):
        h = hashlib.sha512(t.lower().encode()).digest()
        raw = [int.from_bytes(h[i : i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(0, 64, 4)]
        n = math.sqrt(sum(x * x for x in raw))
        return [x / n for x in raw]

    q, want = unit(query), []
    for i, t in enumerate(texts):
        sem = sum(a * b for a, b in zip(q, unit(t), strict=True))
        kw = len({w for w in t.split() if len(w) > 2} & set(query.split())) / 3
        kind = "hybrid" if sem > 0.1 and kw > 0.1 else "semantic" if sem > kw else "keyword"
        want.append((round(0.6 * sem + 0.4 * kw, 9), i, kind))
    got = [(round(r.score, 9), r.source_id, r.match_type) for r in retrieval.hybrid_search(index, query, 3).collect()]
    assert got == sorted(want, key=lambda x: -x[0])[:3]


def test_nearest_against_all_pairs(spark):
    rows = [(i, [float((i * 7 + k * k) % 11 - 5) for k in range(6)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.query_id, r.id): r.score for r in retrieval.nearest(d, d.where("id % 20 = 0"), "id", "v", 4).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-12, math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)))
    for q, v in rows[::20]:
        best = sorted(((round(cos(v, w), 6), -i) for i, w in rows if i != q), reverse=True)[:4]
        assert {k[1] for k in got if k[0] == q} == {-i for _, i in best}


def test_b18_halves_go_up(spark):
    assert one(spark, F.round(F.col("v")), v=2.5) == 3.0 and one(spark, F.round(F.col("v"), 2), v=0.125) == 0.13


def test_b19_b20_nulls_last_and_ids_decide(spark):
    d = spark.createDataFrame([(3, None), (2, 1.0), (1, 1.0), (4, 2.0)], "id int, v double")
    assert [r.id for r in d.orderBy(F.desc_nulls_last("v"), "id").collect()] == [4, 1, 2, 3]


def test_b21_only_seeds_are_compared_longest_first(spark):
    d = spark.createDataFrame([(1, "deep home cleaning"), (1, "home cleaning"), (1, "cleaning"), (1, "roof repair")], "k int, n string")
    got = {r.n: r.canonical for r in documents.resolve(d, "k", "n").collect()}
    assert got["home cleaning"] == "deep home cleaning" and got["roof repair"] == "roof repair"


def test_b22_null_is_hashed_as_a_word(spark):
    d = spark.createDataFrame([(None, 1.0), ("x", None)], "a string, b double")
    assert [r.h for r in d.select(content_hash(("a", "string"), ("b", "double")).alias("h")).collect()] == [hashlib.sha256(x.encode()).hexdigest() for x in ("null|1.000000", "x|null")]


def test_b23_b31_short_and_constant_series(spark):
    d = spark.createDataFrame([([],), ([3.0],), ([2.0, 2.0, 2.0],)], "v array<double>")
    assert [r.s for r in d.select(series.slope(F.col("v")).alias("s")).collect()] == [0.0, 0.0, 0.0]


def test_b29_b30_currencies(spark):
    assert one(spark, currency(F.col("t")), t="500 only") == "INR" and one(spark, currency(F.col("t"), "USD"), t="500 only") == "USD"
    assert one(spark, currency(F.col("t")), t="from €20") == "EUR" and one(spark, price(F.col("t")), t="12 euro") == 12.0


def test_b34_unread_dates_are_null(spark):
    assert one(spark, F.try_to_timestamp(F.col("t"), F.lit("yyyy-MM-dd")), t="05/06/2026") is None


def test_horizons_and_entity_keys(spark):
    assert [one(spark, horizon_days(F.col("t")), t=t) for t in (" 3M ", "1year", "soon")] == [90, 365, 30]
    assert one(spark, entity_key("t"), t="The AC & HVAC Services (plans)") == "air conditioning heating ventilation air conditioning"


def test_links(spark):
    assert one(spark, is_tracking(F.col("t")), t="https://a.b/c?x=1&GCLID=2#f") and not one(spark, is_tracking(F.col("t")), t="https://a.b/c?x=1")
    assert one(spark, canonical_link(F.col("t")), t='<link href="HTTPS://www.A.b//c/?utm_source=1" rel="canonical">') == "https://a.b/c"
    handle = lambda t: one(spark, social_handle(F.col("t")), t=t)
    assert tuple(handle("https://www.linkedin.com/company/acme/")) == ("linkedin.com", "acme") and handle("https://linkedin.com/feed") is None
    assert handle("https://twitter.com/") is None and tuple(handle("https://m.facebook.com/acme?x=1")) == ("facebook.com", "acme")


def test_nodes_of_loose_html(spark):
    html = "<ul><li>a<li>b <b>c</b></ul><p>x<p>y<br>z</div><table><tr><td>1<td>2</table><script>if (a<b) {}</script>"
    n = dom.nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    got = [(r.page_id, r.tag, r.text, r.above) for r in n.where("tag in ('li', 'td', 'p', 'b')").orderBy("node").collect()]
    assert [g[:3] for g in got] == [(1, "li", "a"), (1, "li", "b c"), (1, "b", "c"), (1, "p", "x"), (1, "p", "yz"), (1, "td", "1"), (1, "td", "2")]
    assert got[2][3] == ["li", "ul"] and n.where("page_id > 1").count() == 0


def test_fields_merge_by_confidence(spark):
    c = spark.createDataFrame([(1, "name", "json_ld", "Acme"), (1, "name", "regex", "acme"), (1, "name", "table", "Other Co"), (1, "email", "regex", "not one"), (1, "email", "generic", "a@b.c"), (1, "x", "faq", None)], "id int, field string, strategy string, value string")
    merged = {r.field: (r.value, r.strategy) for r in dom.merge_fields(dom.field_confidence(c)).collect()}
    assert merged == {"name": ("Acme", "json_ld"), "email": ("a@b.c", "generic")}


def test_zip_metrics_and_kept_results(spark, tmp_path):
    latest = spark.createDataFrame([(1, "2024-01-02", 5.0), (1, "2024-01-01", 4.0), (2, "2024-01-01", 1.0)], "competitor_id long, day string, v double")
    pages = spark.createDataFrame([(1, 10, "<p>x"), (1, 11, None)], "competitor_id long, page_id long, html string")
    got = {r.competitor_id: zipfile.ZipFile(io.BytesIO(bytes(r.zip))) for r in files.zips(latest, pages).collect()}
    assert got[1].namelist() == ["latest.json", "pages/10.html", "pages/11.html"] and json.loads(got[1].read("latest.json"))["v"] == 5.0 and got[2].namelist() == ["latest.json"]
    files.metrics({"latest": latest, "pages": pages}, str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m")) == ["latest", "pages"] and spark.read.json(str(tmp_path / "m" / "latest")).count() == 3
    out = files.materialize(latest, str(tmp_path / "t"), "competitor_id", "day")
    out = files.materialize(latest.selectExpr("competitor_id", "'2025-01-01' as day", "v + 1 as v").where("competitor_id = 2"), str(tmp_path / "t"), "competitor_id", "day")
    assert {r.competitor_id: r.v for r in out.collect()} == {1: 5.0, 2: 2.0}


def test_crawl_states(spark):
    p = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b"), (3, "u3", "c")], "page_id long, url string, html string")
    before = files.snapshots(spark.createDataFrame([(1, "u1", "a"), (2, "u2", "x")], "page_id long, url string, html string"))
    assert {r.page_id: r.state for r in files.crawl_state(p, before).collect()} == {1: "unchanged", 2: "changed", 3: "new"}


@pytest.mark.parametrize("days,want", [(0, 0), (40, 40)])
def test_ages(spark, days, want):
    d = datetime.date(2024, 3, 1)
    assert spark.createDataFrame([(d, d + datetime.timedelta(days))], "a date, b date").select(F.datediff("b", "a")).first()[0] == want
