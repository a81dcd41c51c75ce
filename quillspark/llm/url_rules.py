"""URL filters by association rules: frequent token combinations of labelled URLs decide the others.

1. A URL gives at most one token of each of ``KINDS``; FP-growth's itemsets grow exponentially with the tokens
   of a row, so their number is bounded by the kinds and not by how long a URL is.
2. URLs that a fixed rule decides are the labels. Spark's FP-growth mines the combinations of tokens and label
   that hold at least ``min_support`` of them; those of at least ``min_confidence`` become rules, and a rule goes
   if a part of its tokens says the same with no less confidence.
3. Rules are kept as an inverted index of (token, rule). URLs without a fixed rule are cut to the tokens of the
   index, equal ones become one row, and a rule matches where as many tokens are found as it has.

Only DataFrame functions and Spark's FP-growth run here. A rule holds ``min_support`` of all labelled URLs, so
there are at most ``2 ** len(KINDS) / min_support`` rules and ``len(KINDS) / min_support`` tokens in them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, named, whole
from quillspark.session import materialize


@dataclass(frozen=True)
class HostRule:
    """A verdict on a host, all its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules to which all URLs are held first.
BASE_RULES = (
    HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"), HostRule("net", "/fr/", "block"),
)
KINDS = ("tld", "site", "name", "host", "dir", "page", "ext", "query", "mark")
VERDICTS = ("allow", "block")
LABEL = "verdict="


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def fixed_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last one that fits is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted tokens, at most one of each kind: end, last two and first label of the host, the host, first directory, kind
    of page name, ending, first query key, and whether there is a fragment."""
    text = F.coalesce(url, F.lit(""))
    page = F.regexp_extract(path, r"([^/]*)$", 1)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#&=]*)", 1)
    values = {
        "tld": F.regexp_extract(host, r"([^.]*)$", 1), "site": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "name": F.regexp_extract(host, r"^([^.]*)\.", 1), "host": host, "dir": F.regexp_extract(path, r"^/([^/]+)/", 1),
        "page": F.when(page.rlike(r"^[0-9]+(\.|$)"), "number").when(page != "", "word").when(path.endswith("/"), "folder").otherwise(""),
        "ext": F.regexp_extract(page, r"\.([^.]+)$", 1), "query": query, "mark": F.when(F.instr(text, "#") > 0, "yes").otherwise(""),
    }
    tokens = [F.when(values[k] != "", F.concat(F.lit(k + ":"), values[k])) for k in KINDS]
    return F.array_sort(F.array_compact(F.array(*tokens)))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.01, min_count: int = 10, min_confidence: float = 0.6,
) -> DataFrame:
    """``tokens, verdict, support, confidence`` of the rules of ``labelled`` (``tokens`` array, ``verdict``).

    A rule's tokens and verdict stand together in at least ``min_support`` of the rows, and ``min_count`` of them.
    Rows without a verdict or tokens count as rows but give no rules; too few rows give none.
    """
    spark = labelled.sparkSession
    empty = "tokens array<string>, verdict string, support double, confidence double"
    n = labelled.count()
    least = max(int(-(-min_support * n // 1)), min_count)
    if n < least:
        return spark.createDataFrame([], empty)
    items = F.array_append(F.col("tokens"), F.concat(F.lit(LABEL), F.col("verdict")))
    model = FPGrowth(
        itemsCol="items", minSupport=max(least - 0.5, 0.5) / n, minConfidence=min_confidence
    ).fit(labelled.select(F.coalesce(items, F.array().cast("array<string>")).alias("items")))
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(LABEL) + 1})").alias("verdict"),
        "support", "confidence",
    )
    return pruned(materialize(found))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules of which no proper part of the tokens gives the same verdict with at least the same confidence.

    A part has at most as many tokens as there are kinds, so its parts are made as rows and looked up.
    """
    size = F.size("tokens")
    masks = F.filter(F.sequence(F.lit(1), F.shiftleft(F.lit(1), len(KINDS)) - 2), lambda m: m < F.expr("shiftleft(1, size(tokens))") - 1)
    parts = rules.where(size > 1).select("tokens", "verdict", "confidence", F.explode(masks).alias("m")).select(
        "tokens", "verdict", "confidence", F.expr("filter(tokens, (t, i) -> shiftright(m, i) & 1 = 1)").alias("part")
    )
    general = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("general"))
    beaten = parts.join(general, ["part", "verdict"]).where("general >= confidence").select("tokens", "verdict").distinct()
    return materialize(rules.join(beaten, ["tokens", "verdict"], "left_anti"))


def matched(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """``signature, verdict, confidence, reason`` of the best rule that fits each of the distinct token arrays.

    Best: highest confidence, then support, then fewest tokens, then first in the order of their names.
    """
    reason = F.array_join("tokens", ",").alias("reason")
    listed = rules.select(reason, F.size("tokens").alias("need"), "verdict", "support", "confidence", F.explode("tokens").alias("token"))
    order = F.struct(-F.col("confidence"), -F.col("support"), "need", "reason", "verdict")
    return (
        signatures.select("signature", F.explode("signature").alias("token")).join(listed, "token")
        .groupBy("signature", "reason", "verdict", "need", "support", "confidence").agg(F.count(F.lit(1)).alias("n")).where("n = need")
        .groupBy("signature").agg(F.min_by(F.struct("verdict", "confidence", "reason"), order).alias("best"))
        .select("signature", "best.*")
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[HostRule] = BASE_RULES, default: str = "allow", url: str = "url", **mining
) -> DataFrame:
    """One row per row of ``pages``: its columns in a struct ``page``, and ``host, path, rule, verdict, reason, confidence``.

    The longest fixed rule decides; else the best mined rule (``reason`` holds its tokens), else ``default``.

    * Null URLs and those without ``://``: host and path are empty, no rule fits; tokens of what is there may.
    * Very long URLs are read whole and give as many tokens as others. Repeated rows are judged alike, each labelled
      one counts. An empty table gives no rows; without labels all get ``default``. Columns of any name may stand in
      ``pages``, as the row is carried in one struct.
    """
    link = named([url])[0]
    rows = pages.select(F.struct(*named(pages.columns)).alias("page"), link.alias("url"))
    rows = rows.select("page", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("fixed", verdict).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    mined = mine_rules(rows.where("rule is not null").select("tokens", F.col("fixed").alias("verdict")), **mining)
    # bounded by the support: see the head of the module
    known = sorted(r["token"] for r in mined.select(F.explode("tokens").alias("token")).distinct().collect())
    in_index = F.array_intersect("tokens", F.lit(known) if known else F.array().cast("array<string>"))
    rows = rows.withColumn("signature", F.when(F.col("rule").isNull(), in_index))
    # stored: Spark sees its size, and ships it to the pages instead of moving them by a signature that most may share
    decided = materialize(matched(rows.select("signature").where("size(signature) > 0").distinct(), mined))
    return rows.join(decided, "signature", "left").select(
        "page", "host", "path", "rule", F.coalesce("fixed", "verdict", F.lit(default)).alias("verdict"), "reason", "confidence",
    )


def url_report(pages: DataFrame, page_id: str = "page_id", **options) -> DataFrame:
    """``page_id`` and what :func:`judge_urls` says of each row."""
    judged = judge_urls(pages.select(*named([page_id, options.get("url", "url")])), **options)
    return judged.select(F.col("page")[page_id].alias("page_id"), "host", "path", "rule", "verdict", "reason", "confidence")
