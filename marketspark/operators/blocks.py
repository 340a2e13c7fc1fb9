"""Pages cut into blocks and segments, typed by what speaks for each type.

Everything stands on the tree of dom.tree(): whether an element is split depends on counts over its own subtree only, so all
elements are judged at once, and a node's block is the topmost element above it that is not split. No page is walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.vocabulary import FAQ_START, PRICE_TEXT, ROLE_TYPES, SCHEMA_TYPES, SEGMENT_TYPES, SEGMENT_WORDS, TAG_TYPES

#: Landmarks, which are always split; containers, which are split if they hold two blocks or more; blocks of
#: different tags that still make a repeated pattern; tags that are no block by themselves.
LANDMARKS = ["header", "nav", "main", "footer", "aside"]
BOUNDARIES = [*LANDMARKS, "section", "article"]
CONTAINERS = ["div", "section", "article"]
ALIKE = ["div", "article", "section", "li", "td", "th", "figure", "blockquote"]
PHRASES = "script style template br hr wbr span a b i em strong small sub sup img input button label select textarea h1 h2 h3 h4 h5 h6 p figure figcaption".split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Children that make a repeated pattern, characters that each has at least; characters of a segment at least.
REPEATED, REPEATED_TEXT, SEGMENT_TEXT = 3, 10, 20


def _in_body(t: DataFrame, key: str) -> DataFrame:
    """The nodes below the body (below the root where there is none), with `body`; scripts are left out."""
    body = t.where("tag in ('body', '#root')").groupBy(key).agg(F.coalesce(F.min(F.when(F.col("tag") == "body", F.col("node"))), F.lit(0)).alias("body"))
    return t.where("tag != '#script'").join(body, key).where(F.array_contains("up", F.col("body")))


def _judged(b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Children and units. Children: key, node, parent, body, tag, grp, loose, base. Units, which are a parent's children or,
    where headings part them, one part: key, parent, grp, mode (children, repeat, atomic), parted."""
    below = b.select(key, F.explode("up").alias("node"), "tag", F.length("text").alias("size"))
    is_text, tag = F.col("tag") == "#text", F.col("tag")
    facts = below.groupBy(key, "node").agg(F.sum(F.when(is_text, F.col("size")).otherwise(0)).alias("size"), F.bool_or(tag.isin(*HEADINGS, "p")).alias("spoken"))
    kids = b.select(key, "node", "parent", "body", "tag").join(facts, [key, "node"], "left")
    base = F.when(F.col("parent") == F.col("body"), "div").otherwise(F.col("base"))
    tags = b.select(key, F.col("node").alias("parent"), F.col("tag").alias("base"))
    kids = kids.join(tags, [key, "parent"], "left").withColumn("base", base).withColumn("loose", is_text | tag.isin(*PHRASES))
    among = Window.partitionBy(key, "parent")
    head = tag.isin("h1", "h2", "h3")
    kids = kids.withColumn("parted", ~F.col("base").isin(*BOUNDARIES) & (F.count_if(head).over(among) >= 2))
    kids = kids.withColumn("grp", F.when(F.col("parted"), F.count_if(head).over(among.orderBy("node"))).otherwise(0).cast("int"))
    own = ~F.col("loose")
    unit = kids.groupBy(key, "parent", "grp").agg(
        F.first("base").alias("base"),
        F.first("parted").alias("parted"),
        F.count_if(own).alias("n"),
        F.min(F.when(own, F.coalesce("size", F.lit(0)))).alias("least"),
        F.count_if(own & F.coalesce("spoken", F.lit(False))).alias("spoken"),
        (F.min(F.when(own, tag)) == F.max(F.when(own, tag))).alias("same"),
        F.bool_and(~own | tag.isin(*ALIKE)).alias("alike"),
    )
    repeat = (F.col("n") >= REPEATED) & (F.col("same") | F.col("alike")) & (F.col("least") >= REPEATED_TEXT) & (F.col("spoken") >= F.floor(F.col("n") / 2))
    box = F.col("base").isin(*CONTAINERS) | F.col("parted")
    mode = F.when(F.col("base").isin(*BOUNDARIES), F.when(F.col("n") > 0, "children")).when(repeat, "repeat").when(box & (F.col("n") >= 2), "children")
    return kids, unit.select(key, "parent", "grp", "parted", F.coalesce(mode, F.lit("atomic")).alias("mode"))


def members(t: DataFrame, key: str) -> DataFrame:
    """The nodes of the body with `block`, the number of the block's first node, `top` (a block's outermost nodes) and `kind`
    (element: one element; run: siblings). Nodes above all blocks are left out; every text is in exactly one block.

    An element is split into its children if it is a landmark, section or article; at its headings (h1 to h3) if two or more
    are its children, each part being split like a div; into repeated children (three or more with text, alike, half of them
    with a heading or paragraph); or if it is a container (the body too) of two blocks or more. Otherwise it is a block. What
    stands between split children, texts and phrases, is a block per run."""
    b = _in_body(t, key)
    kids, units = _judged(b, key)
    mine = units.where("not parted").select(key, F.col("parent").alias("node"), F.col("mode").alias("inner"))
    parts = units.where("parted").select(key, F.col("parent").alias("node"), F.lit(True).alias("inner_parted")).distinct()
    kids = kids.drop("parted").join(units, [key, "parent", "grp"]).join(mine, [key, "node"], "left").join(parts, [key, "node"], "left")
    among = Window.partitionBy(key, "parent", "grp").orderBy("node")
    kids = kids.withColumn("run", F.count_if(~F.col("loose")).over(among))
    atomic = F.coalesce("inner", F.lit("atomic")) == "atomic"
    part = F.struct("parent", "grp", F.lit(-1).cast("bigint").alias("run"))
    stop = (
        F.when((F.col("mode") == "atomic") & F.col("parted"), part)
        .when(F.col("mode") == "atomic", F.lit(None))
        .when(F.col("loose"), F.struct("parent", "grp", "run"))
        .when((F.col("mode") == "repeat") | (atomic & F.col("inner_parted").isNull()), F.struct(F.col("node").alias("parent"), F.lit(-1).alias("grp"), F.lit(-1).cast("bigint").alias("run")))
    )
    stops = kids.withColumn("stop", stop).where("stop is not null")
    stops = stops.select(key, F.col("node").alias("at"), F.min("node").over(Window.partitionBy(key, "stop")).alias("block"), F.when(F.col("stop.grp") < 0, "element").otherwise("run").alias("kind"))
    path = b.select(key, "node", F.explode(F.concat(F.array("node"), "up")).alias("at"))
    found = path.join(stops, [key, "at"]).groupBy(key, "node").agg(F.min(F.struct("at", "block", "kind")).alias("s"))
    whole = units.join(b.select(key, F.col("body").alias("parent")).distinct(), [key, "parent"]).where("mode = 'atomic' and not parted").select(key, F.col("parent").alias("one"))
    # A body that isn't split is one block.
    out = b.join(found, [key, "node"], "left").join(whole, key, "left").where("s is not null or one is not null")
    return out.select(key, "node", "parent", "tag", "attrs", "text", "up", "above", F.coalesce("one", "s.block").alias("block"), (F.coalesce("one", "s.at") == F.col("node")).alias("top"), F.when(F.col("one").isNotNull(), "element").otherwise(F.col("s.kind")).alias("kind"))


def words_score(text: Column, kind: str) -> Column:
    """0.12 for each of the type's words in the text (lower case already), 0.15 for a price, 0.10 for a question; 0.6 at most."""
    words = SEGMENT_WORDS.get(kind, [])
    score = 0.12 * F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))) if words else F.lit(0.0)
    if kind == "pricing":
        score = score + F.when(text.rlike(PRICE_TEXT), 0.15).otherwise(0.0)
    if kind == "faq":
        score = score + F.when(text.rlike(FAQ_START), 0.10).otherwise(0.0)
    return F.least(F.lit(0.6), score)


def features(m: DataFrame, key: str, unit: str) -> DataFrame:
    """What classified() looks at, a row a unit. m: rows (key, unit, node, parent, tag, attrs, text, up, above, own, child):
    the nodes of each unit; own: the unit's element itself, if it is one; child: the unit's outermost nodes, or its
    element's children."""
    tag, text, own = F.col("tag"), F.col("text"), F.col("own")
    is_text = tag == "#text"
    inside = F.arrays_zip(F.col("up").alias("u"), F.col("above").alias("a"))
    up = lambda test: F.filter(inside, lambda x: test(x["a"]) & (x["u"] >= F.col(unit)))
    head = F.try_element_at(up(lambda a: a.rlike("^h[1-6]$")), F.lit(1))
    table = F.try_element_at(up(lambda a: a == "table"), F.lit(-1))
    titled = F.size(up(lambda a: a == "th")) > 0
    m = m.withColumns({"_head": F.when(is_text, head), "_table": F.when(is_text & titled, table)})
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("node")))
    itemtype = F.nullif(F.regexp_extract(F.try_element_at("attrs", F.lit("itemtype")), "([^/]*)$", 1), F.lit(""))
    attribute = lambda name: F.lower(F.coalesce(F.max(F.when(own, F.try_element_at("attrs", F.lit(name)))), F.lit("")))
    grid = [F.count_if(F.col("child") & (tag == x)) for x in ("div", "li", "article", "section", "a")]
    g = m.groupBy(key, unit).agg(
        F.coalesce(F.max(F.when(own, tag)), F.lit("div")).alias("tag"),
        attribute("role").alias("role"),
        attribute("aria-label").alias("aria"),
        F.coalesce(F.max(F.when(own, itemtype)), first(itemtype)).alias("schema"),
        F.array_sort(F.collect_list(F.when(F.col("_head").isNotNull(), F.struct(F.col("_head.a").alias("level"), F.col("_head.u").alias("at"), "node", "text")))).alias("_heads"),
        F.array_sort(F.collect_list(F.when(is_text, F.struct("node", "text")))).alias("_texts"),
        F.array_sort(F.collect_list(F.when(F.col("_table").isNotNull(), F.struct(F.col("_table.u").alias("at"), "text")))).alias("_titles"),
        F.min(F.when((tag == "table") & ~own, F.col("node"))).alias("_table"),
        F.count_if((tag == "form") & ~own).alias("forms"),
        F.count_if(tag.isin("details", "summary") & ~own).alias("qa"),
        F.count_if((tag == "a") & ~own).alias("links"),
        F.count_if((tag == "p") & ~own).alias("paragraphs"),
        F.greatest(*grid).alias("grid"),
    )
    said = lambda c, test=None: F.concat_ws(" ", F.transform(F.filter(c, test) if test else F.col(c), lambda x: x["text"]))
    lead = F.try_element_at("_heads", F.lit(1))
    heading = said("_heads", lambda x: (x["level"] == lead["level"]) & (x["at"] == lead["at"]))
    titles = F.lower(said("_titles", lambda x: x["at"] == F.col("_table")))
    return g.select(key, unit, "tag", "role", "aria", "schema", "forms", "qa", "links", "paragraphs", "grid", heading.alias("heading"), said("_texts").alias("text"), F.when(F.col("_table").isNotNull(), titles).alias("titles"))


def classified(f: DataFrame, key: str, unit: str) -> DataFrame:
    """features() with place (from 0), type and confidence: by tag (0.5), role (0.45), label (0.2), schema type (0.4), words of
    the heading (0.35 at most) and of the text (0.25 at most, less for texts of over 800 characters), place on the page, forms,
    tables, questions, links, copyright, and repeated children (0.1). Ties go to the type that stands first; below 0.08 it is
    unknown with 0.1; otherwise the confidence is held between 0.1 and 0.95."""
    order = Window.partitionBy(key).orderBy(unit)
    f = f.withColumn("place", F.row_number().over(order) - 1).withColumn("last", F.lead(unit).over(order).isNull())
    low, size = F.lower("text"), F.length("text")
    share = F.when(size < 800, 1.0).otherwise(F.greatest(F.lit(0.3), 800 / size))
    looked = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(""))
    f = f.withColumns({"_low": low, "_head": F.lower("heading"), "_share": share, "_tag": looked(TAG_TYPES, F.col("tag")), "_role": looked(ROLE_TYPES, F.col("role")), "_schema": looked(SCHEMA_TYPES, F.coalesce("schema", F.lit("")))})
    yes = lambda test, value: F.when(test, value).otherwise(0.0)
    links = (F.col("links") > 0) & (F.least("links", F.lit(30)) > 3 * F.least("paragraphs", F.lit(10)))
    priced = F.col("titles").rlike("price|cost|plan|rate")
    more = {
        "hero": yes(F.col("place") == 0, 0.20),
        "footer": yes(F.col("last"), 0.25) + yes(F.contains("_low", F.lit("©")) | F.contains("_low", F.lit("copyright")), 0.30),
        "contact": yes(F.col("forms") > 0, 0.20),
        "pricing": yes(priced, 0.25),
        "services": yes(F.col("titles").isNotNull() & ~priced, 0.10),
        "faq": yes(F.col("qa") >= 2, F.least(F.lit(0.25), 0.15 * F.col("qa"))),
        "navigation": yes(links, 0.15),
    }
    score = {}
    for kind in SEGMENT_TYPES:
        s = yes(F.col("_tag") == kind, 0.5)
        s = F.when(F.col("_role") == kind, F.greatest(s, F.lit(0.45))).otherwise(s)
        if kind in SEGMENT_WORDS:
            labelled = F.exists(F.array(*[F.lit(w) for w in SEGMENT_WORDS[kind]]), lambda w: F.contains("aria", w))
            s = s + yes(labelled, 0.2) + F.least(F.lit(0.35), 1.4 * words_score(F.col("_head"), kind))
            s = s + words_score(F.col("_low"), kind) * F.col("_share") * 0.25 / 0.60
        s = s + yes(F.col("_schema") == kind, 0.4) + more.get(kind, F.lit(0.0))
        score[kind] = F.round(s, 9)
    f = f.withColumns({f"_s_{k}": s for k, s in score.items()})
    # A repeated pattern speaks for prices if these lead, else for services.
    grid = F.when(F.col("grid") >= REPEATED, 0.1).otherwise(0.0)
    leads = F.col("_s_pricing") > F.col("_s_services")
    added = {"pricing": F.when(leads, grid).otherwise(0.0), "services": F.when(leads, 0.0).otherwise(grid)}
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"_s_{k}") + added.get(k, F.lit(0.0)), 9).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("type")) for i, k in enumerate(SEGMENT_TYPES)]))
    f = f.withColumn("_best", best)
    unknown = F.col("_best.score") < 0.08
    kind = F.when(unknown, "unknown").otherwise(F.col("_best.type"))
    sure = F.when(unknown, 0.1).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.col("_best.score"))))
    return f.select(key, unit, "place", kind.alias("type"), sure.alias("confidence"), "heading", "text")


def blocks(t: DataFrame, key: str) -> DataFrame:
    """key, block, type, confidence, heading, text, parts: the blocks of each page in order, neighbours of one type merged
    (parts: how many; the best confidence, the first heading). Pages without text have none."""
    m = members(t, key)
    div = (F.col("kind") == "element") & F.col("top") & (F.col("tag") == "div")
    boxes = m.where(div).select(key, F.col("node").alias("parent"), F.lit(True).alias("box"))
    m = m.join(boxes, [key, "parent"], "left").withColumn("own", div)
    m = m.withColumn("child", (F.col("box") & (F.col("parent") == F.col("block"))) | (F.col("top") & ~F.col("own"))).na.fill(False, ["child"])
    c = classified(features(m, key, "block").where("text != ''"), key, "block")
    order = Window.partitionBy(key).orderBy("block")
    new = F.coalesce(F.lag("type").over(order) != F.col("type"), F.lit(True))
    c = c.withColumn("_new", new).withColumn("_run", F.count_if("_new").over(order))
    texts = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]))
    merged = c.groupBy(key, "_run").agg(F.min("block").alias("block"), F.first("type").alias("type"), F.max("confidence").alias("confidence"), F.min_by("heading", "block").alias("heading"), texts.alias("text"), F.count("*").alias("parts"))
    return merged.drop("_run")


def page_segments(t: DataFrame, key: str) -> DataFrame:
    """key, node, tag, type, confidence, heading, text: the typed segments of each page in order.

    Candidates are landmarks wherever they stand, and sections, articles and divs with 20 characters of text, spaces between
    its pieces counted, that are children of the body or of the first main. Those that stand in another candidate are left out, but for landmarks. A page
    without candidates is one unknown segment, its body."""
    b = _in_body(t, key)
    sized = b.where("tag = '#text'").select(key, F.explode("up").alias("node"), F.length("text").alias("n")).groupBy(key, "node").agg((F.sum(F.col("n") + 1) - 1).alias("size"))
    main = b.where("tag = 'main'").groupBy(key).agg(F.min("node").alias("main"))
    tag = F.col("tag")
    el = b.where(tag.isin(*BOUNDARIES, "div")).join(sized, [key, "node"], "left").join(main, key, "left")
    near = (F.col("parent") == F.col("body")) | (F.col("parent") == F.col("main"))
    c = el.where(tag.isin(*LANDMARKS) | (near & (F.coalesce("size", F.lit(0)) >= SEGMENT_TEXT))).select(key, F.col("node").alias("seg"), "up", tag.alias("seg_tag"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("seg")))
    above = c.select(key, "seg", F.explode("up").alias("at")).join(c.select(key, F.col("seg").alias("at")), [key, "at"]).select(key, "seg").distinct().withColumn("inner", F.lit(True))
    kept = c.join(above, [key, "seg"], "left").where(F.col("inner").isNull() | F.col("seg_tag").isin(*LANDMARKS)).select(key, "seg", "seg_tag")
    path = b.select(key, "node", "parent", "tag", "attrs", "text", "up", "above", F.explode(F.concat(F.array("node"), "up")).alias("seg"))
    m = path.join(c.select(key, "seg"), [key, "seg"]).withColumn("own", F.col("node") == F.col("seg")).withColumn("child", F.col("parent") == F.col("seg"))
    typed = classified(features(m, key, "seg"), key, "seg").drop("place").join(kept, [key, "seg"])
    typed = typed.select(key, F.col("seg").alias("node"), F.col("seg_tag").alias("tag"), "type", "confidence", "heading", "text")
    # Pages without candidates.
    whole = t.where("tag in ('body', '#root')").groupBy(key).agg(F.max("node").alias("node"), F.max_by("tag", "node").alias("tag"))
    said = t.where("tag = '#text'").groupBy(key).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"])).alias("text"))
    bare = whole.join(c.select(key).distinct(), key, "left_anti").join(said, key, "left")
    return typed.unionByName(bare.select(key, "node", "tag", F.lit("unknown").alias("type"), F.lit(0.1).alias("confidence"), F.lit("").alias("heading"), F.coalesce("text", F.lit("")).alias("text")))
