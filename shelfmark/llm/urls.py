"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from LABELLED, a small table of hosts and paths, by
full-batch gradient descent; its weights are rounded to integers, so a score is an exact
sum in any engine and any order. Scoring is DataFrame code: the n-grams of ``^host$`` and
``/path`` are hashed by a polynomial of their characters, made distinct and looked up in a
literal array of BUCKETS weights.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and
the verdict of the model on two empty strings; urls of any length count with all their n-grams;
null page_ids and repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read

#: host, path, verdict, longest key first wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BUCKETS, SIZES = 2048, (3, 4, 5)
UNIT = 1 << 16
#: Host stems labelled 1 (advertising, gambling, pills, spam) and 0; each stands on several hosts and paths.
BLOCKED = (
    "cheap-pills", "casino-win", "free-bets", "ads-track", "spam-farm", "online-casino", "buy-pills", "bet-bonus", "adserver", "tracker-ads",
    "win-money", "pills-shop", "spam-links", "casino-slots", "sports-bets", "click-ads", "farm-links", "free-casino", "cheap-meds", "track-pixel",
    "poker-win", "loan-fast", "hot-dates", "replica-watch", "lottery-win", "free-spins", "spamblog", "ads-popunder", "jackpot-bet", "viagra-cheap",
)
ALLOWED = (
    "news", "science", "library", "school", "recipes", "weather", "gardening", "history", "museum", "travel-notes", "music", "health-info", "city-council",
    "open-data", "photo-club", "university", "football", "chess-club", "freedom-press", "trackandfield", "winter-sports", "farming-today", "better-homes",
    "adsorption-lab", "link-library", "moneyweek", "cheapside-history", "betty-blog", "spanish-course", "verlag", "maison", "casa-azul", "garten",
    "theatre", "another-view", "nation-today", "mountain-huts", "the-record", "ocean-research", "tradition", "wandern", "zeitung", "ecole", "cuisine",
    "boulangerie", "biblioteca", "noticias", "escuela", "rathaus", "bahnhof", "heritage-trust", "teacher-forum", "weather-north", "orchard", "northern-line",
)
HOSTS = ("{}.example.com", "www.{}.example.org", "m.{}.example.net", "{}.info", "blog.{}.test")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/", "/es/{}")


def labelled() -> list[tuple[str, str, int]]:
    """The training table: (host, path, label)."""
    return [(h.format(s), p.format((17 * i + 101 * k) % 997), y) for y, stems in ((1, BLOCKED), (0, ALLOWED)) for i, s in enumerate(stems) for k, (h, p) in enumerate(zip(HOSTS, PATHS))]


def grams(host: str, path: str) -> list[int]:
    """Distinct buckets of the n-grams of ``^host$`` and of the path."""
    return sorted({_bucket(t[i : i + n], n) for t in (f"^{host}$", path) for n in SIZES for i in range(len(t) - n + 1)})


def _bucket(gram: str, n: int) -> int:
    h = n
    for c in gram:
        h = (h * 131 + ord(c)) % 1000003
    return h * 613 % 1000003 % BUCKETS


@lru_cache
def train(rows: tuple[tuple[str, str, int], ...] | None = None, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Intercept and weights of the regression, in units of 1/UNIT."""
    rows = labelled() if rows is None else rows
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        x[i, grams(host, path)] = 1
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) * 8 + decay * w)
        b -= rate * error.mean()
    return round(b * UNIT), tuple(int(round(v * UNIT)) for v in w)


def _hashed(text: F.Column, n: int) -> F.Column:
    def bucket(i):
        h = F.lit(n)
        for k in range(n):
            h = (h * 131 + F.ascii(F.substring(text, i + k, 1))) % 1000003
        return (h * 613 % 1000003 % BUCKETS + 1).cast("int")

    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), bucket)).otherwise(F.array().cast("array<int>"))


def classify(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score in units of 1/UNIT."""
    intercept, weights = train()
    has = F.col("url").contains("://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    parts = pages.select("page_id", F.when(has, rest).otherwise("").alias("rest"))
    lower = F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = parts.select("page_id", lower.alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    found = [(F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.lit(h + p)), v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    host, path = F.concat(F.lit("^"), "host", F.lit("$")), F.col("path")
    buckets = F.array_distinct(F.concat(*[_hashed(t, n) for t in (host, path) for n in SIZES]))
    table = F.expr(f"array({','.join(map(str, weights))})")
    scored = parts.withColumn("score", F.aggregate(F.transform(buckets, lambda b: F.element_at(table, b).cast("long")), F.lit(intercept).cast("long"), lambda a, w: a + w))
    rule = F.coalesce(*[r for r, _ in found])
    by_rule = F.coalesce(*[F.when(r.isNotNull(), F.lit(v)) for r, v in found])
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "pages", "page_id", "url"))


def oracle() -> str:
    intercept, weights = train()

    def hashed(text: str, n: int) -> str:
        h = str(n)
        for k in range(n):
            h = f"(({h}) * 131 + unicode(substr({text}, i + {k}, 1))) % 1000003"
        return f"list_transform(range(1, greatest(length({text}) - {n - 2}, 1)), lambda i: CAST(({h}) * 613 % 1000003 % {BUCKETS} + 1 AS INT))"

    lists = ", ".join(hashed(t, n) for t in ("'^' || host || '$'", "path") for n in SIZES)
    lists = f"flatten([{lists}])"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " WHEN score > 0 THEN 'block' ELSE 'allow' END"
    return f"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
grams AS (SELECT *, list_distinct({lists}) AS buckets FROM parts),
weights AS (SELECT [{','.join(map(str, weights))}] AS w),
scored AS (SELECT page_id, host, path, CAST({intercept} + coalesce(list_sum(list_transform(buckets, lambda b: w[b])), 0) AS BIGINT) AS score FROM grams, weights)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, score FROM scored"""
