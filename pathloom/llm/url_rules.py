"""URL filters: association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pathloom.llm.common import free_name, saved
from pathloom.operators.joins import lookup_join

ALLOW, BLOCK = "allow", "block"
#: Fixed list: (verdict, host, path).
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels by their place from the end, path steps by depth, query keys.

    Digits become ``0``, so numbered pages share their tokens.
    """

    def digits(c: Column) -> Column:
        return F.regexp_replace(c, "[0-9]+", "0")

    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), digits(x)))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), digits(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.concat(F.lit("s:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    has = F.coalesce(url, F.lit("")).contains("://")
    return F.when(has, F.array_distinct(F.concat(F.array(scheme), labels, steps, keys))).otherwise(F.array().cast("array<string>"))


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """(items, alike) for rows (row, tokens, label): of tokens that stand in the same rows the first one stays.

    ``alike`` of a row has (token kept, all tokens it stands for). Such tokens have every support and confidence in
    common, and each subset of them is a frequent set of its own: merged, a URL of many tokens is one item. Tokens in
    fewer than ``least`` rows go. The rows of a token are told by their number and two sums of hashes.
    """
    each = saved(rows.select("row", F.explode("tokens").alias("token")), "url-tokens")
    marks = each.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("s")
    ).where(F.col("n") >= least)
    groups = saved(marks.groupBy("n", "x", "s").agg(F.sort_array(F.collect_list("token")).alias("same")), "url-alike")
    kept = groups.select(F.col("same")[0].alias("token"), "same")
    merged = lookup_join(each, kept, "token", spread=F.xxhash64("row"))
    return merged.groupBy("row").agg(F.collect_list(F.struct("token", "same")).alias("alike"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_rows: int = 5) -> DataFrame:
    """(tokens, verdict, confidence, support, alike) of rules that lead from URL tokens to a label.

    ``labelled``: tokens array<string>, label string. FP-growth runs on all labelled rows;
    tokens below ``min_support``, or in fewer than ``min_rows`` rows, take no part. Tokens that stand in the same rows are
    one item: ``tokens`` names the first of them, ``alike`` lists for each all that it stands for, and any of these
    fits. A rule is pruned if its label is no likelier than
    among all rows, or if a rule with fewer of its
    tokens has the same verdict and at least its confidence. Rows without a label are
    ignored; without labelled rows there are no rules.
    """
    schema = "tokens array<string>, verdict string, confidence double, support double, alike array<array<string>>"
    spark = labelled.sparkSession
    rows = labelled.where("label IS NOT NULL AND tokens IS NOT NULL")
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "label"), "url-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    merged = saved(_merged(rows, max(min_rows, math.ceil(min_support * n - 1e-9))), "url-merged")
    label = F.array(F.concat(F.lit("="), "label"))
    items = F.concat(F.coalesce("alike.token", F.array().cast("array<string>")), label)
    items = saved(rows.select("row", "label").join(merged, "row", "left").select(items.alias("items")), "url-items")
    least = max(min_support, (min_rows - 0.5) / n)
    model = FPGrowth(itemsCol="items", minSupport=min(least, 1.0), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where("lift > 1").where(F.element_at("consequent", 1).startswith("=")).where(~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = found.select(
        F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 2)").alias("verdict"), "confidence", "support"
    )
    rules = saved(rules, "url-rules")
    # Fewer tokens: each rule is looked up under its tokens with one of them, or more, left out.
    parts = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("left")).select(
        F.col("tokens"), "verdict", "confidence", F.array_except("tokens", F.array("left")).alias("part")
    )
    best = _best_within(rules, parts)
    rules = rules.join(best, ["tokens", "verdict"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("confidence"))).drop("within")
    same = merged.select(F.explode("alike").alias("a")).select(F.col("a.token").alias("token"), F.col("a.same").alias("same")).distinct()
    each = lookup_join(rules.select("tokens", F.explode("tokens").alias("token")).distinct(), same, "token")
    alike = each.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("token", "same")))["same"].alias("alike"))
    return rules.join(alike, "tokens")


def _best_within(rules: DataFrame, parts: DataFrame) -> DataFrame:
    """The highest confidence of a rule with a part of the tokens, level by level of the lattice.

    Every part of a frequent set is frequent, so going down by one token at a time reaches
    all rules inside; a part below the confidence limit is no rule and is passed through.
    """
    known = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("within"))
    frontier, out = parts.select("tokens", "verdict", "part"), None
    while True:
        frontier = saved(frontier.where(F.size("part") > 0).distinct(), "url-parts")
        if frontier.isEmpty():
            break
        hit = frontier.join(known, ["part", "verdict"]).select("tokens", "verdict", "within")
        out = hit if out is None else out.unionByName(hit)
        frontier = frontier.withColumn("left", F.explode("part")).select("tokens", "verdict", F.array_except("part", F.array("left")).alias("part"))
    if out is None:
        return rules.select("tokens", "verdict", F.lit(0.0).alias("within")).limit(0)
    return out.groupBy("tokens", "verdict").agg(F.max("within").alias("within"))


class RuleIndex:
    """Rules under their rarest token: a URL meets only rules that have one of its tokens there.

    An entry of a rule's tokens is a token, or a list of tokens any of which fits.
    """

    def __init__(self, rules: list[tuple[list, str, float, float]]) -> None:
        rules = [([(t,) if isinstance(t, str) else tuple(t) for t in tokens], *rest) for tokens, *rest in rules]
        times: dict[tuple, int] = defaultdict(int)
        for tokens, *_ in rules:
            for t in tokens:
                times[t] += 1
        self.by_token: dict[str, list[tuple[list[frozenset[str]], str, float, float, list[str]]]] = defaultdict(list)
        for tokens, verdict, confidence, support in rules:
            rule = ([frozenset(t) for t in tokens], verdict, confidence, support, sorted(t[0] for t in tokens))
            for t in min(tokens, key=lambda t: (times[t], t)):
                self.by_token[t].append(rule)

    def best(self, tokens: list[str]) -> tuple[str | None, float, list[str] | None]:
        """(verdict, confidence, tokens) of the rule with the highest confidence, then support, then most tokens."""
        own, top = set(tokens), None
        for t in own:
            for rule in self.by_token.get(t, ()):
                if not any(own.isdisjoint(group) for group in rule[0]):
                    key = (rule[2], rule[3], len(rule[0]), rule[1], rule[4])
                    if top is None or key > top:
                        top = key
        return (None, 0.0, None) if top is None else (top[3], top[0], top[4])


def _matcher(held: Broadcast, schema: T.StructType):
    @F.pandas_udf(schema)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for tokens in parts:
            found = [own.best(list(t) if t is not None else []) for t in tokens]
            yield pd.DataFrame(found, columns=["verdict", "confidence", "tokens"])

    return match


def apply_rules(urls: DataFrame, rules: DataFrame, tokens_col: str = "tokens", block_rules: int = 100_000) -> DataFrame:
    """Add a struct ``mined`` (verdict, confidence, tokens): the best rule inside each row's tokens.

    Rules are broadcast in blocks of about ``block_rules``, cut by hash; each block is one
    more pass that keeps the better of its rule and the one before. Rows that no rule fits,
    and rows with null tokens, have a null verdict.
    """
    rules = saved(rules, "url-rules")
    listed = "alike" if "alike" in rules.columns else "tokens"
    blocks = max(1, -(-rules.count() // block_rules))
    schema = T.StructType(
        [T.StructField("verdict", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("tokens", T.ArrayType(T.StringType()))]
    )
    out = urls.select(*[c for c in urls.columns if c.lower() != "mined"], F.lit(None).cast(schema).alias("mined"))
    for block in range(blocks):
        part = rules.where(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == block).collect()  # about block_rules rows
        index = RuleIndex([(list(r[listed]), r["verdict"], r["confidence"], r["support"]) for r in part])
        held = urls.sparkSession.sparkContext.broadcast(index)
        new = _matcher(held, schema)(F.col(tokens_col))
        if block:
            out = saved(out, "url-matched")
        name = free_name(out, "_new")
        out = out.withColumn(name, new)
        better = F.col("mined.verdict").isNull() | (F.coalesce(F.col(f"{name}.confidence"), F.lit(0.0)) > F.col("mined.confidence"))
        out = out.withColumn("mined", F.when(better, F.col(name)).otherwise(F.col("mined"))).drop(name)
    return out


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = ALLOW, url_col: str = "url", **options) -> DataFrame:
    """Add host, path, rule, verdict, mined to each row of ``urls``.

    The verdict is the listed rule's; the rows that have one are the labels from which rules on
    tokens are mined, and these judge the rest. A row that neither fits gets ``default``.
    A null url, or one without ``://``, has an empty host and path, no tokens, and so the
    default. Repeated rows are labels each. An empty table gives no rows. Other columns
    stay; ones with these names are replaced.
    """
    new = ("host", "path", "rule", "verdict", "mined")
    url = F.col(url_col).cast("string")
    kept = [c for c in urls.columns if c.lower() not in new]
    parts = urls.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = free_name(parts, "tokens")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict}).withColumn(tokens, url_tokens(url, F.col("host"), F.col("path")))
    mined = mine_rules(parts.select(F.col(tokens).alias("tokens"), F.col("verdict").alias("label")), **options)
    out = apply_rules(parts, mined, tokens)
    return out.withColumn("verdict", F.coalesce("verdict", "mined.verdict", F.lit(default))).drop(tokens)
