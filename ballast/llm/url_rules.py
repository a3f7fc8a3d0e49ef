"""URL filter: fixed host and path rules first, mined association rules after.

Method: every URL becomes a set of tokens.  Spark's FP-growth mines the token
combinations of labelled URLs; rules ``tokens -> block`` are pruned by support,
confidence and redundancy and matched to all URLs through an inverted index
from each rule's rarest token to the rule.  Everything is DataFrame code.

Tokens that occur in the very same labelled URLs are one item, which a URL holds
that holds any of them; so a long template does not make a frequent itemset of
each of its parts.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import bounded_broadcast, staged

#: A rule needs so many labelled URLs, however few there are.
LEAST_ROWS = 10
BLOCK = "label=block"
#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        urls.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", ascii_lower(F.regexp_extract("__rest", r"^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host, then path) as text like ``net/``, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def token_set(url: str = "url") -> Column:
    """The distinct tokens of a URL, sorted: host labels, path words, query keys; runs of digits become ``#``."""
    words = lambda text, mark: F.transform(
        F.filter(F.split(F.regexp_replace(ascii_lower(text), r"[0-9]+", "#"), r"[^a-z0-9#\-]+"), lambda w: F.length(w) > 0),
        lambda w: F.concat(F.lit(mark), w),
    )
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_sort(
        F.array_distinct(F.concat(words(F.col("host"), "h:"), words(F.col("path"), "p:"), words(F.array_join(keys, " "), "q:")))
    )


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, n) of the tokens in at least ``least`` of the rows ``tokens, block``: the first by name of the tokens that occur in the very same rows, and their number.

    Rows are told apart by their tokens and label.  A token is left out only if
    it has too few rows, so there are no more than all rows' tokens by ``least``.
    """
    each = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "block").cast("decimal(20,0)").alias("row"))
    rows = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows")).filter(F.col("n") >= least)
    return rows.select("token", F.min("token").over(Window.partitionBy("n", "rows")).alias("item"), "n")


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Rules ``items -> block`` from rows ``tokens array, block boolean``, and the items of tokens.

    Returns (antecedent, confidence, support, key), antecedent being items and
    key its rarest, and (token, item).  A rule needs ``min_support`` of the rows
    and LEAST_ROWS of them; it goes when a rule of a part of its items has at
    least its confidence.  An empty input gives no rules.
    """
    labelled = staged(labelled.filter(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = labelled.count()
    least = max(LEAST_ROWS, -int(-min_support * total // 1))
    items = staged(items_of(labelled, least), "items")
    kept = bounded_broadcast(items.filter("token = item").select("token"))
    rows = labelled.select("row", "block", F.explode("tokens").alias("token")).join(kept, "token").groupBy("row", "block").agg(F.collect_list("token").alias("items"))
    rows = staged(rows.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "transactions")
    left = max(1, rows.count())
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / left), minConfidence=min_confidence).fit(rows).associationRules
    rules = found.filter(F.col("consequent")[0] == BLOCK).select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * left / max(1, total)).alias("support"))
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("item")).join(bounded_broadcast(items.filter("token = item").select("item", "n")), "item")
        .groupBy("antecedent").agg(F.min(F.struct("n", "item"))["item"].alias("key"))
    )
    rules = staged(rules.join(rarest, "antecedent"), "rules")
    part = rules.select(F.col("key").alias("item"), F.col("antecedent").alias("part"), F.col("confidence").alias("part_c"))
    redundant = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(part, "item")
        .filter((F.size("antecedent") > F.size("part")) & (F.col("part_c") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("antecedent").distinct()
    )
    return staged(rules.join(redundant, "antecedent", "left_anti"), "rules"), items.select("token", "item")


def match_rules(token_sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct ``tokens`` that hold all items of some rule, by an inverted index from each rule's rarest item."""
    index = bounded_broadcast(rules.select(F.col("key").alias("item"), "antecedent"))
    of = bounded_broadcast(items.join(bounded_broadcast(rules.select(F.explode("antecedent").alias("item")).distinct()), "item", "left_semi"))
    sets = (
        token_sets.select("tokens").distinct()
        .select("tokens", F.explode("tokens").alias("token"))
        .join(of, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    )
    return (
        sets.select("tokens", "items", F.explode("items").alias("item")).join(index, "item")
        .filter(F.size(F.array_except("antecedent", "items")) == 0)
        .select("tokens").distinct()
    )


def judge(
    pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, rules=RULES
) -> DataFrame:
    """A verdict on every row of ``pages(page_id, url)``.

    ``labels(page_id, block)`` are the labelled rows; null labels are left out
    and a page with several labels is one transaction for each.  Returns
    page_id, host, path, rule, verdict, one row per input row, repeated rows
    included.  A null URL has no host, path or tokens and is allowed unless a
    fixed rule fits.  Further columns of either input are ignored.
    """
    urls = with_parts(pages.select("page_id", "url")).withColumn("tokens", token_set())
    known = urls.join(labels.select("page_id", "block").filter("block is not null"), "page_id").select("tokens", "block")
    matched = staged(match_rules(urls, *mine_rules(known, min_support, min_confidence)).withColumn("mined", F.lit(True)), "matched")
    matched = bounded_broadcast(matched)  # else joined as written, so that the join can split the rows of one URL
    name, verdict = fixed_rule(rules)
    return urls.join(matched, "tokens", "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
    )
