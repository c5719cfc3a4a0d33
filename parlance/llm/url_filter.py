"""URL filter: domain rules first, then boosted trees over lexical features, in DataFrame expressions only.

The trees are fitted in memory on a bounded set of labelled URLs (made by rule in ``labelled``, or up to ``most`` rows of a table) and
become one SQL expression, so that judging is a single projection over the scan: no shuffle, no Python on executors.
Features: length, path depth, share of digits, entropy of the host, parameters, labels and hyphens of the host, its
longest label, and the smoothed rate of blocked labels under its last label (suffix statistics of the labelled URLs).

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees
on its features (all small: such rows are blocked or allowed alike); repeated rows are judged each; other columns are
ignored; white space and very long URLs need no special care.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import gbt
from parlance.llm.common import table

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of made URLs (either kind uses both lists, in other shares), and suffixes with their weights for allowed and
#: blocked URLs.
SHADY = ("casino", "poker", "bets", "pills", "pharma", "loans", "adult", "spam", "ads", "track", "win", "free", "cheap", "bonus")
PLAIN = ("harbour", "meadow", "library", "garden", "theatre", "museum", "weather", "cooking", "history", "letters", "science", "village", "railway", "school", "journal")
SUFFIXES = {"com": (40, 30), "org": (25, 6), "net": (15, 20), "info": (6, 20), "edu": (8, 1), "top": (2, 12), "biz": (4, 11)}
NAMES = ("url_length", "depth", "digit_share", "host_entropy", "parameters", "host_labels", "hyphens", "longest_label", "suffix_rate")
#: An unwanted URL only becomes more likely with hyphens, digits, parameters, and blocked neighbours under its suffix.
MONOTONE = {NAMES.index(x): 1 for x in ("hyphens", "digit_share", "parameters", "suffix_rate")}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled(n: int = 6000, seed: int = 17, blocked: float = 1 / 3) -> list[tuple[str, int]]:
    """Made URLs with labels (1: block). Both kinds are drawn from the same parts, blocked ones more often with hyphens,
    digits, random names, deep hosts and paths, parameters and doubtful suffixes; each feature's ranges overlap."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    noise = lambda few, many, of="abcdefghijklmnopqrstuvwxyz": "".join(pick(of) for _ in range(int(rng.integers(few, many))))
    names, weights = list(SUFFIXES), np.array(list(SUFFIXES.values()), float)
    out = []
    for _ in range(n):
        y = int(rng.random() < blocked)
        odds = lambda allowed, bad, y=y: rng.random() < (bad if y else allowed)
        word = lambda odds=odds: pick(SHADY if odds(0.1, 0.6) else PLAIN)
        name = "-".join(word() for _ in range(1 + odds(0.08, 0.7) + odds(0.02, 0.25)))
        if odds(0.3, 0.35):  # a long name: letters at random, or words put together
            name = noise(14, 23) if odds(0.1, 0.9) else "".join(pick(PLAIN) for _ in range(2 + int(rng.integers(2))))
        if odds(0.06, 0.3):
            name += noise(1, 5, "0123456789")
        host = [*(pick(("www", "blog", "m", "news", word(), noise(2, 8))) for _ in range(rng.poisson(1.6 if y else 0.5))), name]
        if rng.random() < 0.5:
            host.append("example")
        suffix = names[int(rng.choice(len(names), p=weights[:, y] / weights[:, y].sum()))]
        # deep paths of short parts against shallow ones of long parts, so that length says less than depth
        own = ("en", "de", "fr", "es", noise(1, 4), noise(1, 6), noise(2, 7, "0123456789")) if y else ("en", "de", word(), word() + "-" + word(), noise(3, 12), str(rng.integers(1, 100)))
        parts = [pick(own) for _ in range(rng.poisson(3.2 if y else 1.6))]
        path = "/" + "/".join(parts) + pick(("", "", "/", ".html"))
        query = "&".join(f"{pick(('id', 'q', 'page', 'ref', 'utm_source', noise(1, 4)))}={noise(1, 9, 'abcdef0123456789')}" for _ in range(rng.poisson(1.3 if y else 0.6)))
        out.append((f"http{pick(('s', 's', ''))}://{'.'.join(host)}.{suffix}{path}{'?' * bool(query)}{query}", y))
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Model:
    trees: gbt.Trees
    #: Blocked share (smoothed) of the labelled URLs under each last label of a host; others have the overall share.
    rates: dict[str, float]
    rate: float

    def columns(self, url: Column, host: Column, path: Column) -> dict[str, Column]:
        """The features over whole URLs. ``host`` and ``path`` are columns of their own."""
        url = F.coalesce(url, F.lit(""))
        chars = F.split(host, "")
        share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host)
        entropy = F.when(host == "", 0.0).otherwise(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))))
        labels = F.split(host, r"\.")
        suffix = F.element_at(labels, -1)
        rate = F.lit(self.rate)
        for name, value in sorted(self.rates.items()):
            rate = F.when(suffix == name, value).otherwise(rate)
        size = lambda x: F.length(x).cast("double")
        count = lambda text, c: size(text) - size(F.replace(text, F.lit(c), F.lit("")))
        digits = size(url) - size(F.translate(url, "0123456789", ""))
        return {
            "url_length": size(url),
            "depth": count(path, "/"),
            "digit_share": digits / F.greatest(size(url), F.lit(1.0)),
            "host_entropy": F.round(entropy, 6),
            "parameters": count(url, "="),
            "host_labels": count(host, ".") + F.when(host == "", 0.0).otherwise(1.0),
            "hyphens": count(host, "-"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "suffix_rate": rate,
        }


def parts(url: str) -> tuple[str, str]:
    """Host and path of one URL, as the expressions above have them."""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    if not found:
        return "", ""
    return found[1].translate(str.maketrans(_UPPER, _LOWER)), found[2]


def features(url: str, rates: dict[str, float], rate: float) -> list[float]:
    """The features of one labelled URL, for fitting."""
    host, path = parts(url)
    shares = [host.count(c) / len(host) for c in sorted(set(host))]
    labels = host.split(".")
    return [len(url), path.count("/"), sum(c in "0123456789" for c in url) / max(len(url), 1), round(-sum(p * math.log2(p) for p in shares), 6), url.count("="), host.count(".") + (host != ""), host.count("-"), max(map(len, labels)), rates.get(labels[-1], rate)]


def fit(urls: list[tuple[str, int]]) -> Model:
    """Trees from labelled URLs (label 1: block)."""
    rate = (sum(y for _, y in urls) + 1) / (len(urls) + 2)
    seen: dict[str, list[int]] = {}
    for url, y in urls:
        seen.setdefault(parts(url)[0].split(".")[-1], []).append(y)
    rates = {k: (sum(v) + 8 * rate) / (len(v) + 8) for k, v in seen.items()}
    x = np.array([features(u, rates, rate) for u, _ in urls], float).reshape(-1, len(NAMES))
    return Model(gbt.fit(x, np.array([y for _, y in urls], float), MONOTONE, rounds=24, depth=3, least=4.0), rates, rate)


def fit_table(labels: DataFrame, most: int = 5000) -> Model:
    """Trees from a table (url, label): its rows of smallest hash, ``most`` at most."""
    rows = labels.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
    return fit([(r["url"], r["label"]) for r in rows])


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name = F.when(fits, domain + prefix).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score (the trees' log-odds of block), verdict."""
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "said": verdict} | model.columns(F.col("url"), F.col("host"), F.col("path")))
    own = own.withColumn("score", F.expr(model.trees.sql(list(NAMES))))
    return own.select("page_id", "host", "path", "rule", F.round("score", 6).alias("score"), F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), fit(labelled()))


def oracle(rules=RULES) -> str:
    """The same rows in DuckDB's SQL: the trees are fitted on fixed URLs, so their expression is fixed too."""
    model = fit(labelled())
    rate = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in sorted(model.rates.items()))
    said = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}'))" for _, d, p in said]
    rule = " ".join(f"WHEN {c} THEN '{d}{p}'" for c, (_, d, p) in zip(fits, said, strict=True))
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, (v, _, _) in zip(fits, said, strict=True))
    count = lambda text, c: f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)"
    score = re.sub(r"(\d)D\b", r"\1", model.trees.sql(list(NAMES)))
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), seen AS (
  SELECT page_id, host, path,
    CAST(length(url) AS DOUBLE) AS url_length,
    {count("path", "/")} AS depth,
    length(regexp_replace(url, '[^0-9]', '', 'g')) / greatest(CAST(length(url) AS DOUBLE), 1.0) AS digit_share,
    CASE WHEN host = '' THEN 0.0 ELSE round(list_sum(list_transform(list_distinct(string_split(host, '')),
      lambda c: CASE WHEN c = '' THEN 0.0 ELSE -((length(host) - length(replace(host, c, ''))) / CAST(length(host) AS DOUBLE)) * log2((length(host) - length(replace(host, c, ''))) / CAST(length(host) AS DOUBLE)) END)), 6) END AS host_entropy,
    {count("url", "=")} AS parameters,
    {count("host", ".")} + CASE WHEN host = '' THEN 0.0 ELSE 1.0 END AS host_labels,
    {count("host", "-")} AS hyphens,
    CAST(list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS DOUBLE) AS longest_label,
    CASE list_last(string_split(host, '.')) {rate} ELSE {model.rate!r} END AS suffix_rate,
    CASE {rule} END AS rule,
    CASE {verdict} END AS said
  FROM cut
), scored AS (
  SELECT *, CAST({score} AS DOUBLE) AS score FROM seen
)
SELECT page_id, host, path, rule, round(score, 6) AS score,
  coalesce(said, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM scored
"""
