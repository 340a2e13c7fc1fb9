"""Scores by rule: where a company is, how it scores in five dimensions, and what market scenarios do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.plans.registry import query
from marketspark.sources.tables import competitors, pricing, services, table

#: Cities with state, region and priority, looked for in this order.
CITIES = {
    "chennai": ("Tamil Nadu", "South India", 1), "mumbai": ("Maharashtra", "West India", 2), "bangalore": ("Karnataka", "South India", 2), "bengaluru": ("Karnataka", "South India", 2), "hyderabad": ("Telangana", "South India", 2), "pune": ("Maharashtra", "West India", 3),
    "delhi": ("Delhi", "North India", 3), "new delhi": ("Delhi", "North India", 3), "kolkata": ("West Bengal", "East India", 3), "ahmedabad": ("Gujarat", "West India", 3), "jaipur": ("Rajasthan", "North India", 4), "lucknow": ("Uttar Pradesh", "North India", 4), "coimbatore": ("Tamil Nadu", "South India", 2),
    "madurai": ("Tamil Nadu", "South India", 2), "tiruchirappalli": ("Tamil Nadu", "South India", 2), "salem": ("Tamil Nadu", "South India", 3), "tirunelveli": ("Tamil Nadu", "South India", 3), "erode": ("Tamil Nadu", "South India", 3), "vellore": ("Tamil Nadu", "South India", 3),
}
#: Domains, phone numbers and names of the home state that tell a company of the country.
DOMAINS = (".in", ".co.in", ".org.in", ".net.in", ".gov.in")
PHONES = r"\+91[\s-]?[0-9]{10}|0[0-9]{2,4}[\s-]?[0-9]{6,8}|[0-9]{10}"
HOME, HOME_NAMES = ("chennai", "Tamil Nadu", "South India"), ("tamil nadu", "tamilnadu", "tn")


def location(url: Column, text: Column) -> Column:
    """struct(city, state, region, priority, indian, chennai, phone, domain, confidence) of a company's address and texts. The
    first city of CITIES in the text counts, then the home state's names. Null and empty ones say nothing."""
    low, address = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    domain = F.exists(F.array(*[F.lit(x) for x in DOMAINS]), lambda x: F.contains(address, x))
    phone = F.coalesce(text, F.lit("")).rlike(PHONES)
    city = F
    for name, (state, region, priority) in CITIES.items():
        city = city.when(F.contains(low, F.lit(name)), F.struct(F.lit(name).alias("city"), F.lit(state).alias("state"), F.lit(region).alias("region"), F.lit(priority).alias("priority")))
    city = city.otherwise(F.lit(None))
    home = F.exists(F.array(*[F.lit(x) for x in HOME_NAMES]), lambda x: F.contains(low, x))
    state = F.coalesce(city["state"], F.when(home, HOME[1]))
    chennai = F.coalesce(city["city"] == HOME[0], F.lit(False))
    indian = domain | phone | home | city.isNotNull()
    yes = lambda test, value: F.when(test, value).otherwise(0.0)
    sure = F.when(chennai, 0.5).otherwise(yes(indian, 0.3)) + yes(domain, 0.2) + yes(phone, 0.15) + yes(state.isNotNull(), 0.1) + yes(city.isNotNull(), 0.05)
    return F.struct(
        F.initcap(city["city"]).alias("city"), state.alias("state"), F.coalesce(city["region"], F.when(home, HOME[2])).alias("region"), F.coalesce(city["priority"], F.lit(5)).alias("priority"),
        indian.alias("indian"), chennai.alias("chennai"), phone.alias("phone"), domain.alias("domain"), F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"),
    )


#: Texts of companies: the page's words, and for every third the name of a city, as both sides of the query read it.
_PLACED = "html || CASE WHEN page_id % 3 = 0 THEN ' in ' || (['Chennai', 'New Delhi', 'Pune', 'Salem', 'Erode'])[page_id % 5 + 1] ELSE '' END"


def _city_sql(k: int | None) -> str:
    return "CASE " + " ".join(f"WHEN contains(low, '{n}') THEN {(n.title(), *v)[k]!r}" for n, v in CITIES.items()) + " END"


@query(
    "location_check",
    f"""WITH x AS (SELECT page_id, lower(url) || CASE WHEN page_id % 4 = 0 THEN '.co.in' ELSE '' END AS u, {_PLACED} AS t, lower({_PLACED}) AS low FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
    y AS (SELECT page_id, {_city_sql(0)} AS city, {_city_sql(1)} AS s, {_city_sql(2)} AS r, {_city_sql(3)} AS p, contains(low, 'tn') OR contains(low, 'tamil nadu') OR contains(low, 'tamilnadu') AS home, regexp_matches(t, '{PHONES}') AS phone, contains(u, '.in') AS domain FROM x),
    z AS (SELECT *, coalesce(s, CASE WHEN home THEN 'Tamil Nadu' END) AS state, coalesce(city = 'Chennai', false) AS chennai, domain OR phone OR home OR city IS NOT NULL AS indian FROM y)
    SELECT page_id, city, state, coalesce(r, CASE WHEN home THEN 'South India' END) AS region, coalesce(p, 5)::INTEGER AS priority, indian, chennai, phone, domain,
      round(least(1, CASE WHEN chennai THEN 0.5 WHEN indian THEN 0.3 ELSE 0 END + CASE WHEN domain THEN 0.2 ELSE 0 END + CASE WHEN phone THEN 0.15 ELSE 0 END + CASE WHEN state IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN city IS NOT NULL THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS confidence FROM z""",
)
def _(spark, d):
    p = table(spark, d, "pages").where("html is not null and url is not null")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Chennai", "New Delhi", "Pune", "Salem", "Erode")]), (F.col("page_id") % 5 + 1).cast("int"))
    text = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" in "), name)).otherwise(""))
    url = F.concat(F.lower("url"), F.when(F.col("page_id") % 4 == 0, ".co.in").otherwise(""))
    return p.select("page_id", location(url, text).alias("l")).select("page_id", "l.*")


#: Dimensions of a company's score with their weights, and what each counts: columns that are true, steps of a
#: number (more than the bound, the first that holds), and tags of which the first found counts.
WEIGHTS = {"location": 0.25, "digital_presence": 0.20, "service_quality": 0.20, "trust": 0.20, "market_relevance": 0.15}
FLAGS = {
    "location": {"domain": 10, "phone": 10, "has_city": 10, "home_state": 20},
    "digital_presence": {"android_app": 15, "ios_app": 15, "online_booking": 20, "rated": 15, "listed": 10, "website": 10},
    "service_quality": {"verified": 25, "background_check": 20, "guarantee": 15, "all_day_support": 15, "same_day": 10, "transparent_pricing": 10, "free_quotes": 5},
    "trust": {"certified": 20, "insured": 15, "licensed": 15, "testimonials": 10, "portfolio": 10, "associations": 5},
}
FOLLOWERS, YEARS = ((10000, 20), (1000, 10), (0, 5)), ((10, 25), (5, 15), (2, 10))
TAGS = (({"tier-1": 40, "tier-2": 25, "tier-3": 10}), ({"market-leader": 30, "major-player": 20}), ({"cleaning": 5, "plumbing": 5, "electrical": 5, "appliance-repair": 5, "pest-control": 5}), ({"chennai": 15, "india": 10}))
GRADES, TIERS = ((80, "A"), (60, "B"), (40, "C"), (20, "D")), ((70, "Tier 1"), (50, "Tier 2"), (30, "Tier 3"))


def company_scores(df: DataFrame) -> DataFrame:
    """df with the five dimensions (0 to 100), total, grade and tier. df has the boolean columns of FLAGS, chennai and indian,
    followers, years, and tags (array, in lower case). Null counts as false, 0 or no tags."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    points = {k: sum((F.when(true(c), float(n)).otherwise(0.0) for c, n in v.items()), F.lit(0.0)) for k, v in FLAGS.items()}

    def steps(value: Column, table_: tuple, strict: bool) -> Column:
        out = F
        for bound, n in table_:
            out = out.when(value > bound if strict else value >= bound, float(n))
        return out.otherwise(0.0)

    def tagged(table_: dict[str, int]) -> Column:
        out = F
        for tag, n in table_.items():
            out = out.when(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag), float(n))
        return out.otherwise(0.0)

    points["location"] = points["location"] + F.when(true("chennai"), 50.0).when(true("indian"), 30.0).otherwise(0.0)
    points["digital_presence"] = points["digital_presence"] + steps(F.coalesce("followers", F.lit(0)), FOLLOWERS, True)
    points["trust"] = points["trust"] + steps(F.coalesce("years", F.lit(0)), YEARS, False)
    points["market_relevance"] = sum((tagged(t) for t in TAGS), F.lit(0.0))
    df = df.withColumns({f"{k}_score": F.least(F.lit(100.0), v) for k, v in points.items()})
    df = df.withColumn("total", F.round(sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0)), 6))
    return df.withColumns({"grade": _ladder(GRADES, "F"), "tier": _ladder(TIERS, "Tier 4")})


def _ladder(table_: tuple, last: str) -> Column:
    out = F
    for bound, name in table_:
        out = out.when(F.col("total") >= bound, name)
    return out.otherwise(last)


_FLAG_NAMES = [c for v in FLAGS.values() for c in v]
_TAG_LISTS = ("tier-1,market-leader,cleaning,chennai", "tier-2,india", "tier-3,major-player,plumbing", "pest-control", "")


def _flags_sql() -> str:
    return ", ".join(f"competitor_id % {k + 2} = 0 AS {c}" for k, c in enumerate([*_FLAG_NAMES, "chennai", "indian"]))


def _points_sql(k: str) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in FLAGS[k].items())


def _case_sql(table_: tuple, test: str, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(b)} THEN {n!r}" for b, n in table_) + f" ELSE {last} END"


_TAG_SQL = " + ".join("CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN {n}" for t, n in x.items()) + " ELSE 0 END" for x in TAGS)


@query(
    "company_score_5d",
    f"""WITH n AS (SELECT competitor_id, count(*) AS services, count(DISTINCT category) AS years FROM services GROUP BY 1), c AS (SELECT competitor_id, {_flags_sql()}, coalesce(services, 0) * 137 AS followers, coalesce(years, 0) % 13 AS years,
      string_split((['{"', '".join(_TAG_LISTS)}'])[competitor_id % 5 + 1], ',') AS tags FROM competitors LEFT JOIN n USING (competitor_id)),
    s AS (SELECT competitor_id, least(100, {_points_sql("location")} + CASE WHEN chennai THEN 50 WHEN indian THEN 30 ELSE 0 END)::DOUBLE AS location_score, least(100, {_points_sql("digital_presence")} + {_case_sql(FOLLOWERS, "followers > {0}", "0")})::DOUBLE AS digital_presence_score,
      least(100, {_points_sql("service_quality")})::DOUBLE AS service_quality_score, least(100, {_points_sql("trust")} + {_case_sql(YEARS, "years >= {0}", "0")})::DOUBLE AS trust_score, least(100, {_TAG_SQL})::DOUBLE AS market_relevance_score FROM c),
    t AS (SELECT *, round({" + ".join(f"{w}::DOUBLE * {k}_score" for k, w in WEIGHTS.items())}, 6) AS total FROM s)
    SELECT *, {_case_sql(GRADES, "total >= {0}", "'F'")} AS grade, {_case_sql(TIERS, "total >= {0}", "'Tier 4'")} AS tier FROM t""",
    "competitors",
    "services",
)
def _(spark, d):
    """Five-dimension scores; ids stand for the flags that the tables lack."""
    n = services(spark, d).groupBy("competitor_id").agg(F.count("*").alias("services"), F.count_distinct("category").alias("years"))
    c = competitors(spark, d).select("competitor_id").join(n, "competitor_id", "left")
    flags = {x: F.col("competitor_id") % (k + 2) == 0 for k, x in enumerate([*_FLAG_NAMES, "chennai", "indian"])}
    tags = F.split(F.element_at(F.array(*[F.lit(x) for x in _TAG_LISTS]), (F.col("competitor_id") % 5 + 1).cast("int")), ",")
    c = c.withColumns({**flags, "followers": F.coalesce("services", F.lit(0)) * 137, "tags": tags}).withColumn("years", F.coalesce("years", F.lit(0)) % 13)
    return company_scores(c).select("competitor_id", *[f"{k}_score" for k in WEIGHTS], "total", "grade", "tier")


#: Elasticity of demand, and how much of a change in volume a cut and a war take from the others' share.
ELASTICITY, CUT_SHARE, WAR_SHARE = 1.5, 0.3, 0.2


def scenarios(base: DataFrame, *, cut: float = 0.15, war: float = 20.0, entrant: int = 20, added: int = 5, decline: float = 20.0) -> DataFrame:
    """scenario, measure, value and risk of five scenarios on a one-row market (competitors, services, categories, mean, low):
    a competitor's price cut, a price war, a new competitor, entry to a category and a decline of demand."""
    lit, col = F.lit, F.col
    revenue = lambda c: 100 * ((1 - c) * (1 + c * ELASTICITY) - 1)
    total = col("services") + entrant
    gone = F.greatest(lit(1), F.floor(col("competitors") * decline / 200))
    left = F.greatest(lit(1), col("competitors") - gone)
    all_ = {
        "competitor_price_cut": ("high" if cut > 0.2 else "medium", {"revenue_pct": lit(revenue(cut)), "share_pct": lit(-cut * 100 * ELASTICITY * CUT_SHARE), "new_mean": col("mean") * (1 - cut), "volume_pct": lit(cut * 100 * ELASTICITY)}),
        "price_war": ("high", {"revenue_pct": lit(revenue(war / 100)), "share_pct": lit(-war * ELASTICITY * WAR_SHARE), "new_mean": col("mean") * (1 - war / 100), "floor": col("low") * (1 - war / 100), "break_even_pct": lit(war / (1 - war / 100))}),
        "new_competitor": ("medium", {"share_loss_pct": entrant / total * 100, "services_after": total, "categories_covered": F.least(lit(entrant // 3), col("categories"))}),
        "category_entry": ("low", {"services_after": col("services") + added, "categories_after": col("categories") + 1, "category_share_pct": added / F.greatest(col("services") + added, lit(1)) * 100}),
        "market_decline": ("high" if decline > 20 else "medium", {"surviving": left, "survivor_share_pct": 100 / left, "services_affected": F.floor(col("services") * decline / 100)}),
    }
    rows = [F.struct(lit(s).alias("scenario"), lit(k).alias("measure"), F.round(v.cast("double"), 1).alias("value"), lit(risk).alias("risk")) for s, (risk, values) in all_.items() for k, v in values.items()]
    return base.select(F.inline(F.array(*rows)))


@query(
    "market_scenarios",
    """WITH b AS (SELECT (SELECT count(*) FROM competitors) AS c, (SELECT count(*) FROM services) AS s, (SELECT count(DISTINCT category) FROM services) AS k, avg(price) AS m, min(price) AS lo FROM pricing)
    SELECT scenario, measure, round(value, 1) AS value, risk FROM b, LATERAL (VALUES ('competitor_price_cut', 'revenue_pct', 100 * (0.85 * 1.225 - 1)::DOUBLE, 'medium'), ('competitor_price_cut', 'share_pct', -6.75::DOUBLE, 'medium'), ('competitor_price_cut', 'new_mean', m * 0.85, 'medium'), ('competitor_price_cut', 'volume_pct', 22.5::DOUBLE, 'medium'),
      ('price_war', 'revenue_pct', 4.0::DOUBLE, 'high'), ('price_war', 'share_pct', -6.0::DOUBLE, 'high'), ('price_war', 'new_mean', m * 0.8, 'high'), ('price_war', 'floor', lo * 0.8, 'high'), ('price_war', 'break_even_pct', 25.0::DOUBLE, 'high'),
      ('new_competitor', 'share_loss_pct', 2000.0::DOUBLE / (s + 20), 'medium'), ('new_competitor', 'services_after', (s + 20)::DOUBLE, 'medium'), ('new_competitor', 'categories_covered', least(6, k)::DOUBLE, 'medium'),
      ('category_entry', 'services_after', (s + 5)::DOUBLE, 'low'), ('category_entry', 'categories_after', (k + 1)::DOUBLE, 'low'), ('category_entry', 'category_share_pct', 500.0::DOUBLE / (s + 5), 'low'),
      ('market_decline', 'surviving', greatest(1, c - greatest(1, c // 10))::DOUBLE, 'medium'), ('market_decline', 'survivor_share_pct', 100.0::DOUBLE / greatest(1, c - greatest(1, c // 10)), 'medium'), ('market_decline', 'services_affected', (s // 5)::DOUBLE, 'medium')) t(scenario, measure, value, risk)""",
    "competitors",
    "services",
    "pricing",
)
def _(spark, d):
    p = pricing(spark, d).agg(F.avg("price").alias("mean"), F.min("price").alias("low"))
    s = services(spark, d).agg(F.count("*").alias("services"), F.count_distinct("category").alias("categories"))
    c = competitors(spark, d).agg(F.count("*").alias("competitors"))
    return scenarios(p.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(c)))  # a row each
