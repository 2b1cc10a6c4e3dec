"""URL filter: longest-rule lookup, then hashed n-gram logistic regression.

Everything on the data path is a built-in Spark function: the address is split
by regular expressions, the rules are a literal array, and the linear model is
an array of integer weights indexed by hashed character n-grams. The model is
fitted on the driver from ``LABELLED``, a table of fixed size. An n-gram's weight
in an address is its share of the address's n-grams, when fitting and when
scoring; the logit times the number of n-grams is a sum of whole numbers.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and no n-gram, so its score is 0 and it is allowed. Repeated rows are judged
alike; columns of the input called host, path, rule, verdict or url_score are
replaced.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
DIM = 1024
SIZES = (3, 4)

#: The rules of the contract, (verdict, host, path prefix).
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Small labelled table: 1 is block, 0 is allow.
LABELLED: tuple[tuple[str, int], ...] = (
    ("http://cheap-pills.example.com/buy/now", 1),
    ("http://www.cheap-meds.example.org/order/1", 1),
    ("http://pills-online.example.net/shop/viagra", 1),
    ("https://discount-pills.example.com/offer", 1),
    ("http://spam-farm.example.org/links/200", 1),
    ("https://link-farm.example.net/seo/backlinks", 1),
    ("http://spam-blog.example.com/post/click", 1),
    ("http://free-casino.example.com/bonus/win", 1),
    ("https://casino-bonus.example.net/slots/jackpot", 1),
    ("http://www.poker-casino.example.org/play", 1),
    ("http://xxx-videos.example.com/adult/cams", 1),
    ("https://adult-cams.example.net/xxx", 1),
    ("http://porn-tube.example.org/free", 1),
    ("http://win-free-iphone.example.com/prize/claim", 1),
    ("http://free-money.example.net/click/here", 1),
    ("https://payday-loans.example.org/cash/fast", 1),
    ("http://cheap-watches.example.com/replica", 1),
    ("http://replica-bags.example.net/cheap/buy", 1),
    ("https://click-tracker.example.org/ads/redirect", 1),
    ("http://malware-host.example.com/download/crack.exe", 1),
    ("http://warez-crack.example.net/keygen", 1),
    ("http://cheap-tickets-spam.example.org/en/12", 1),
    ("http://spam-farm.example.net/fr/31", 1),
    ("https://www.cheap-pills.example.org/de/440", 1),
    ("http://sport-bets.example.com/odds/live", 1),
    ("https://free-bets-online.example.org/en/90", 1),
    ("http://ads-network.example.net/track/pixel", 1),
    ("https://ad-track.example.org/fr/77", 1),
    ("http://win-casino.example.net/de/15", 1),
    ("http://lottery-win.example.com/es/8", 1),
    ("https://news.example.com/world/2024/05/article", 0),
    ("http://www.bakery.example.net/de/brot", 0),
    ("https://railway.example.com/en/7", 0),
    ("http://m.theatre.example.org/es/905", 0),
    ("https://blog.chemistry.example.net/fr/3384", 0),
    ("http://www.township.example.com/de/1201", 0),
    ("https://harbour.example.org/en/46/", 0),
    ("https://www.example.org/about", 0),
    ("http://blog.example.net/posts/12", 0),
    ("https://docs.example.com/guide/install.html", 0),
    ("https://library.example.org/catalog/item/88", 0),
    ("http://university.example.net/research/papers", 0),
    ("https://m.weather.example.com/en/city/17", 0),
    ("https://museum.example.org/fr/collection", 0),
    ("http://www.garden.example.net/de/rosen", 0),
    ("https://recipes.example.com/es/sopa", 0),
    ("https://science.example.org/en/physics/300", 0),
    ("http://history.example.net/en/rome.html", 0),
    ("https://www.orchestra.example.com/fr/52", 0),
    ("http://blog.carpentry.example.org/en/671", 0),
    ("https://m.timetable.example.net/en/25", 0),
    ("http://observatory.example.com/es/114", 0),
    ("https://forum.example.net/thread/991", 0),
    ("https://code.example.org/project/readme", 0),
    ("http://city-council.example.com/minutes/2020", 0),
    ("https://hospital.example.net/health/advice", 0),
    ("https://sports.example.org/de/fussball/33", 0),
    ("http://travel.example.com/en/guide/lisbon", 0),
    ("https://www.music-school.example.net/fr/cours", 0),
    ("http://ocean.example.org/es/480/", 0),
)


def split_address(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as the Spark expressions give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host.translate(str.maketrans(UPPER, LOWER)), tail[:end]


def buckets(host: str, path: str) -> list[int]:
    """Feature index of each n-gram; the path's lie DIM above the host's."""
    out = []
    for shift, part in ((0, f"^{host}$"), (DIM, f"^{path}$")):
        codes = [ord(c) for c in part]
        for n in SIZES:
            for i in range(len(codes) - n + 1):
                code = 0
                for c in codes[i : i + n]:
                    code = code * 31 + c
                out.append(shift + code % DIM)
    return out


#: Factor of the n-grams' shares, so that weights and bias are of one size.
SCALE = 16


@lru_cache(maxsize=8)
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, epochs: int = 400, rate: float = 0.5, l2: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Full-batch gradient descent; bias and weights (times ``SCALE``) in thousandths, so sums are exact."""
    rows = []
    for url, y in labelled:
        found = buckets(*split_address(url))
        x: dict[int, float] = {}
        for b in found:
            x[b] = x.get(b, 0.0) + SCALE / len(found)
        rows.append((x, y))
    w, bias = [0.0] * (2 * DIM), 0.0
    for _ in range(epochs):
        grad: dict[int, float] = {}
        gb = 0.0
        for x, y in rows:
            z = bias + sum(w[b] * v for b, v in x.items())
            err = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) - y
            gb += err
            for b, v in x.items():
                grad[b] = grad.get(b, 0.0) + err * v
        for b, g in grad.items():
            w[b] -= rate * (g + l2 * w[b])
        bias -= rate * gb / len(rows)
    return round(1000 * bias), tuple(round(1000 * SCALE * v) for v in w)


def n_grams(part: Column) -> Column:
    """N-grams of ``^part$``, as ``buckets`` counts them."""
    return sum((F.greatest(F.length(part) + 3 - n, F.lit(0)) for n in SIZES), F.lit(0)).cast("long")


def _score(part: Column, weights: Column, shift: int) -> Column:
    def weighed(codes: Column, n: int) -> Column:
        def gram(i: Column) -> Column:
            code = F.lit(0).cast("long")
            for k in range(n):
                code = code * 31 + F.get(codes, i + k)
            return F.get(weights, (code % DIM + shift).cast("int")).cast("long")

        last = F.size(codes) - n
        index = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(index, F.lit(0).cast("long"), lambda a, i: a + gram(i))

    # The character codes are bound once; a lambda's body is evaluated anew for each n-gram.
    codes = F.transform(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), F.ascii)
    return F.get(F.transform(F.array(codes), lambda c: sum((weighed(c, n) for n in SIZES), F.lit(0).cast("long"))), F.lit(0))


def judge_urls(
    df: DataFrame,
    url: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    labelled: tuple[tuple[str, int], ...] = LABELLED,
) -> DataFrame:
    """Add host, path, rule, verdict and url_score (thousandths of a logit, times the n-grams).

    A rule fits its host and every subdomain when the path starts with the
    rule's; of several, the longest (host and path together) wins, and among
    equally long ones the greater string. Without a rule the model decides.
    """
    bias, weights = train(labelled)
    raw = F.col(f"`{url}`")
    host = F.coalesce(F.translate(F.regexp_extract(raw, ADDRESS, 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(raw, ADDRESS, 2), F.lit(""))
    df = df.withColumns({"host": host, "path": path})
    h, p = F.col("host"), F.col("path")
    fits = [
        F.when(
            ((h == rh) | h.endswith("." + rh)) & p.startswith(rp),
            F.struct(F.lit(len(rh + rp)).alias("size"), F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, rh, rp in rules
    ]
    best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.lit(list(weights))
    score = F.lit(bias).cast("long") * (n_grams(h) + n_grams(p)) + _score(h, table, 0) + _score(p, table, DIM)
    df = df.withColumns({"__best": best, "url_score": score})
    return df.withColumns(
        {
            "rule": F.col("__best.rule"),
            "verdict": F.coalesce(F.col("__best.verdict"), F.when(F.col("url_score") > 0, "block").otherwise("allow")),
        }
    ).drop("__best")


def oracle() -> str:
    """DuckDB SQL of ``op4_url_filter`` with the fitted weights written in."""
    bias, weights = train()

    def score(part: str, shift: int) -> str:
        terms = []
        for n in SIZES:
            code = "0"
            for k in range(n):
                code = f"({code}) * 31 + {part}[i + {k}]"
            terms.append(f"coalesce(list_sum(list_transform(range(1, len({part}) - {n - 2}), lambda i: w[(({code}) % {DIM}) + {shift + 1}])), 0)")
        return " + ".join(terms)

    grams = " + ".join(f"greatest(len({part}) - {n - 1}, 0)" for part in ("hc", "pc") for n in SIZES)
    cases = " ".join(
        f"WHEN (host = '{rh}' OR ends_with(host, '.{rh}')) AND starts_with(path, '{rp}') THEN '{{}}{rh + rp}{{}}{v}'".replace("{}", "|")
        for v, rh, rp in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    return f"""
WITH a AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
b AS (
  SELECT *, {list(weights)}::BIGINT[] AS w,
    list_transform(string_split('^' || host || '$', ''), lambda c: unicode(c)::BIGINT) AS hc,
    list_transform(string_split('^' || path || '$', ''), lambda c: unicode(c)::BIGINT) AS pc,
    CASE {cases} END AS hit
  FROM a)
SELECT page_id, host, path,
  CASE WHEN hit IS NULL THEN NULL ELSE string_split(hit, '|')[2] END AS rule,
  CASE WHEN hit IS NOT NULL THEN string_split(hit, '|')[3]
       WHEN {bias} * ({grams}) + {score('hc', 0)} + {score('pc', DIM)} > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM b"""
