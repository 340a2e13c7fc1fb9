"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by its content (SHA-256), so copies and versions that come back are one blob. The
ledger is a table of what has been scanned: a row holds a blob, the rule versions that one run looked for in it, and what
they found, so that a scan and its findings are written in the same commit. A run scans a blob only for the rule versions
that no row names for it; a changed rule gets a new version and nothing else is scanned again. Findings go back to paths by
a join on the blob.

Main path: DataFrame functions only. Spans come from lengths: a regular expression cuts a text into the pieces between its
matches, and running sums of both lengths are the places. Texts are shuffled once, each distinct one per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import documents, fresh, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """kind: name of the finding. pattern: leftmost matches that don't overlap. A match of fewer than `least` characters in
    `group` (0: the whole) is dropped, but still takes its place. A change of any of these needs another version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in their order. Runs of one class of characters are asked for by length at once: a run is
#: either long enough or not.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats of well-known tokens, whose prefix tells them.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
LEDGER = "blob binary, rules array<string>, findings array<struct<start:int,rank:int,end:int,rule:string>>"


def address(text: Column) -> Column:
    """SHA-256 of the text's bytes. Null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _by_rule(rule: Column, rules: tuple[Rule, ...], value) -> Column:
    """value(r) for the rule of the row; null for none."""
    out = F.when(rule == rules[0].id, value(rules[0]))
    for r in rules[1:]:
        out = out.when(rule == r.id, value(r))
    return out


def spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of texts (blob, text, rules still to look for); blob tells the rows apart.

    A text in which no rule matches gives a row without findings. Empty texts hold nothing."""
    anything = F.col("text").rlike("|".join(f"(?:{r.pattern})" for r in rules))
    # A row a text without its text, and one a rule for the texts in which any rule matches.
    none = F.array(F.lit(None).cast("string"))
    pairs = texts.select("blob", "text", "rules", F.explode(F.when(anything, F.concat(none, "rules")).otherwise(none)).alias("rule"))
    lengths = lambda cut: F.transform(cut, lambda x: F.length(x))
    text, rule = F.col("text"), F.col("rule")
    gap = _by_rule(rule, rules, lambda r: lengths(F.split(text, r.pattern, -1)))
    whole = _by_rule(rule, rules, lambda r: lengths(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))))
    part = _by_rule(rule, rules, lambda r: lengths(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))))
    cut = pairs.select("blob", F.when(rule.isNull(), F.col("rules")).alias("rules"), "rule", gap.alias("gap"), whole.alias("whole"), part.alias("part"))
    each = cut.select("blob", "rules", "rule", F.posexplode_outer(F.arrays_zip("gap", "whole", "part")).alias("pos", "m"))
    each = each.where("rule is null or m.whole is not null")
    end = F.sum(F.col("m.gap") + F.col("m.whole")).over(Window.partitionBy("blob", "rule").orderBy("pos")).cast("int")
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.least)])
    rank = F.array_position(F.array(*[F.lit(r.id) for r in rules]), rule).cast("int") - 1
    found = F.struct((end - F.col("m.whole")).alias("start"), rank.alias("rank"), end.alias("end"), "rule")
    placed = each.select("blob", "rules", F.when(F.col("m.part") >= least[rule], found).alias("found"))
    return placed.groupBy("blob").agg(F.max("rules").alias("rules"), F.array_sort(F.collect_list("found")).alias("findings"))


class Ledger:
    """The ledger in `folder`, a place that all executors share. Runs append to it, one at a time.

    A run that fails leaves no rows: what it was to scan is unseen for the next one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/scans"

    def rows(self) -> DataFrame:
        """blob, rules, findings: a row for each blob and run that scanned it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(self.folder) if there else self.spark.createDataFrame([], LEDGER)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, text, rules: the distinct texts of versions (column text) with the rule versions not yet looked for."""
        texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        every = F.array(*[F.lit(r.id) for r in rules])
        texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        return texts.join(seen, "blob", "left").select("blob", "text", todo.alias("rules")).where(F.size("rules") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Looks in the texts of versions for the rule versions that the ledger hasn't for them, and appends the rows.

        Null texts are empty; repeated rows and copies are one blob; other columns are not read."""
        spans(self.unseen(versions, rules), rules).write.mode("append").parquet(self.folder)

    def findings(self, versions: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The `keep` columns of every row of versions, with `findings`: array of (start, rank, end, rule) of these rule
        versions, by start and rule, empty for none; null for a text not scanned. Columns of that name can't be kept."""
        blob, *_ = fresh(versions, "blob")
        ids = F.array(*[F.lit(r.id) for r in rules])
        rank = lambda x: (F.array_position(ids, x["rule"]) - 1).cast("int")
        now = lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["rule"].alias("rule"))
        found = F.flatten(F.collect_list("findings"))
        found = F.array_sort(F.transform(F.filter(found, lambda x: F.array_contains(ids, x["rule"])), now))
        # Stored, so that a blob with many paths is a skewed join that Spark can split.
        by_blob = stored(self.rows().groupBy("blob").agg(found.alias("findings"))).withColumnRenamed("blob", blob)
        paths = versions.select(*[F.col(f"`{k}`") for k in keep], address(F.col("text")).alias(blob))
        return paths.join(by_blob, blob, "left").select(*[F.col(f"`{k}`") for k in keep], "findings")


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.substring_index(x["rule"], "@", 1), x["start"], x["end"])))


def digest(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """The contract's rows for op11. A row a row of docs, repeated ones too; null doc_ids stay; an empty table gives none."""
    ledger.scan(docs)
    found = F.col("findings")
    base = F.filter(found, lambda x: x["rank"] < len(BASE))
    counted = lambda k: F.size(F.filter(found, lambda x: x["rank"] == k)).cast("long")
    count = [counted(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return ledger.findings(docs, ["doc_id"]).select("doc_id", *count, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(found).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), Ledger(spark, shared_dir(spark)))


def _found_sql(k: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''").replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
    return f"""SELECT rid, {k} AS rank, '{r.kind}' AS kind, m.e - m.w AS s, m.e AS e FROM (
      SELECT rid, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'e': list_sum(g[1:i]) + list_sum(w[1:i]), 'w': w[i], 'p': p[i]}})) AS m FROM (
        SELECT rid, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g,
          list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) AS w,
          list_transform(regexp_extract_all(text, '{pattern}', {r.group}), lambda x: length(x)) AS p
        FROM d WHERE regexp_matches(text, '{pattern}'))) WHERE m.p >= {r.least}"""


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found_sql(k, r) for k, r in enumerate(RULES))}),
lists AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (rid)"""
