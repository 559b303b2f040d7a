"""URL filter: longest-prefix rules, then logistic regression on character n-grams.

Rules name a host and the start of a path. The verdict of URLs without a rule
comes from a logistic regression on hashed character n-grams of host and path,
fitted on the small labelled table below (``LABELLED``, at most ``MAX_LABELLED``
rows are used). Fitting is plain arithmetic on that table, done once where the
plan is built; its weights are rounded to integers, so scoring is a sum of longs
over a literal array and needs DataFrame functions only.

Defined cases: host and path of a null URL, or one without ``://``, are empty and
the model judges the empty features by its intercept; very long URLs are scored
whole; repeated rows count each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path start)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BUCKETS = 1024
GRAMS = (3, 4)
SCALE = 1_000_000
MAX_LABELLED = 512
_BAD = (
    "casino poker bonus jackpot slots viagra pills cheap replica loans payday adult cams escort dating crack keygen warez torrent serial spam backlinks followers claim prize "
    "win-cash betting tracker click-ads pixel redirect popunder"
).split()
_GOOD = (
    "news articles science guide docs library books museum wiki history forum thread products reports weather school lessons health advice code projects recipes travel cities "
    "archive music albums maps journal issue sports results contact research papers university"
).split()
_LANGS, _ENDS = ("en", "de", "fr", "es"), ("org", "net", "com", "info", "biz")


def _invented(words: list[str], label: int, rows: int) -> tuple[tuple[str, int], ...]:
    """Addresses of a kind: hosts and paths from its words, in the shapes that crawls hold."""
    n, out = len(words), []
    for i in range(rows):
        a, b, c = words[i % n], words[(7 * i + 3 + i // n) % n], words[(11 * i + 5 + 3 * (i // n)) % n]
        end, lang = _ENDS[i % 5], _LANGS[i // 5 % 4]
        out.append((f"http{'s' * (i % 2)}://{a}.example.{end}/{b}/{c}", f"http://www.{a}-{b}.example.{end}/{c}?id={i}", f"https://{b}.example.{end}/{lang}/{c}/{100 + 37 * i}.html", f"http://{c}{i % 9}.example.{end}/{a}-{b}/")[i % 4])
    return tuple((u, label) for u in out)


def _plain(rows: int) -> tuple[tuple[str, int], ...]:
    """Ordinary numbered pages, allowed."""
    return tuple((f"https://{w}.example.{_ENDS[i % 5]}/{_LANGS[i % 4]}/{1000 + 311 * i}{('', '/', '.html', '#top')[i % 4]}", 0) for i, w in enumerate(("www", "blog", "shop", "site", "press", "home") * (rows // 6)))


#: (url, 1 if it is to be blocked): invented addresses, at most MAX_LABELLED rows of which are used.
LABELLED = _invented(_BAD, 1, 132) + _invented(_GOOD, 0, 132) + _plain(66)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: str, path: str) -> list[str]:
    """The n-grams of both parts, marked by part, as the Spark expression makes them."""
    return [mark + text[i: i + n] for mark, text in (("h", host), ("p", path)) for n in GRAMS for i in range(len(text) - n + 1)]


def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) % BUCKETS


def _parts(url: str) -> tuple[str, str]:
    _, _, rest = url.partition("://")
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host):].partition("?")[0].partition("#")[0]
    return host.lower(), path


@lru_cache(maxsize=4)
def fit(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 200, rate: float = 8.0, decay: float = 1e-4) -> tuple[int, ...]:
    """Integer weights by bucket, and the intercept as the last one, by gradient descent."""
    x, y = np.zeros((min(len(labelled), MAX_LABELLED), BUCKETS)), np.array([v for _, v in labelled[:MAX_LABELLED]], float)
    for row, (url, _) in zip(x, labelled):
        own = sorted({bucket(g) for g in grams(*_parts(url))})
        row[own] = 1 / math.sqrt(max(1, len(own)))
    w, b, n = np.zeros(BUCKETS), 0.0, max(1, len(x))
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(b + (x * w).sum(axis=1)))) - y
        w -= rate * ((x * off[:, None]).sum(axis=0) / n + decay * w)
        b -= rate * float(off.sum()) / n
    return tuple(int(v) for v in np.rint(w * SCALE)) + (round(b * SCALE),)


def blocked(host: Column, path: Column, weights: tuple[int, ...]) -> Column:
    """Sum of the weights of the distinct buckets / sqrt(their number) + intercept > 0: integers, then double arithmetic."""
    model = F.expr(f"array({', '.join(f'{x}L' for x in weights[:-1])})")

    def of(mark: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))), 1, 6), 16, 10).cast("int") % BUCKETS))

    every = F.array_distinct(F.concat(*[of(m, t, n) for m, t in (("h", host), ("p", path)) for n in GRAMS]))

    def over(buckets: Column) -> Column:
        total = F.aggregate(buckets, F.lit(0).cast("long"), lambda s, i: s + F.get(model, i))
        return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")) + F.lit(float(weights[-1])) > 0

    return F.transform(F.array(every), over)[0]  # bound by a one-element transform: the buckets are made once


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    weights = fit(tuple(labelled))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):  # the longest that fits comes first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    rule = F.lit(None).cast("string") if rule is None else rule
    # Asked only where no rule decides.
    by_model = F.when(blocked(F.col("host"), F.col("path"), weights), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), (by_model if verdict is None else verdict.otherwise(by_model)).alias("verdict"))


def query_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def urls_sql() -> str:
    weights = fit()
    sets = ", ".join(f"list_transform(range(1, greatest(len({t}) - {n - 2}, 1)), lambda i: '{m}' || substr({t}, i, {n}))" for m, t in (("h", "host"), ("p", "path")) for n in GRAMS)
    tests = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(k, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for k, h, p in tests]
    return f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT *, list_distinct(list_transform(flatten([{sets}]), lambda x: CAST('0x' || substr(md5(x), 1, 6) AS INTEGER) % {BUCKETS})) AS b FROM u),
m AS (SELECT *, coalesce(list_sum(list_transform(b, lambda i: ({list(weights[:-1])}::BIGINT[])[i + 1])), 0) AS total FROM g)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for _, r, f in fits)} END AS rule,
       CASE {' '.join(f"WHEN {f} THEN '{k}'" for k, _, f in fits)}
       WHEN CAST(total AS DOUBLE) / sqrt(CAST(greatest(len(b), 1) AS DOUBLE)) + {float(weights[-1])}::DOUBLE > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM m"""
