"""URL filter: rules first, else a logistic regression on hashed character n-grams.

Features are the three-character n-grams of the host and, apart from them, of the
path, hashed into ``BUCKETS`` buckets. The model is trained on the driver from a
small labelled table of URLs (a parameter); scoring is Spark SQL alone. Weights
are whole numbers (millionths), so the sum does not depend on its order.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
HOST_SALT, PATH_SALT = 17, 1031
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: The labelled table, of hosts and of path words. (1 to block)
_HOSTS = {
    1: ("casino-win.example.com", "m.casino-win.example.net", "free-pills.example.com", "cheap-pills.example.org", "www.casino-bonus.example.com", "xxx-cams.example.net", "win-prize.example.org", "best-casino.example.net", "blog.free-loans.example.com", "slots-jackpot.example.com", "ads-server.example.com", "adult-chat.example.net", "spam-links.example.org", "bets-online.example.com"),
    0: ("thonth.example.org", "www.tionre.example.net", "blog.erthan.example.com", "m.inghe.example.com", "news.example.org", "library.example.net", "docs.example.com", "university.example.org", "weather.example.net", "m.ththed.example.org", "museum.example.com", "www.gardening.example.net", "city-council.example.org", "blog.history.example.com"),
}
_WORDS = {
    1: ("casino-bonus", "free-pills", "xxx", "jackpot", "win-a-prize", "cheap-loans", "adult", "online-bets"),
    0: ("articles", "library", "weather", "manual", "recipes", "history", "council", "lessons"),
}
#: The same for both labels, so that only words can tell them apart.
_PATHS = ("/", "/en/{}/", "/de/{}?utm_source=feed", "/fr/{}.html")


def _labelled() -> tuple[tuple[str, int], ...]:
    """Each host with each path, and each path word on a neutral host; the numbers in paths run through the table and are shared by both labels."""
    out = []
    for i, pair in enumerate(zip(_HOSTS[1], _HOSTS[0])):
        for host, label in zip(pair, (1, 0)):
            out += [(f"https://{host}{path.format(7 * i + j + 1)}", label) for j, path in enumerate(_PATHS)]
    for i, pair in enumerate(zip(_WORDS[1], _WORDS[0])):
        for word, label in zip(pair, (1, 0)):
            out += [(f"https://{host}.example.org/{word}/{11 * i + 3}", label) for host in ("site", "pages")]
    return tuple(out)


LABELLED = _labelled()


def _host_path_py(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:]
    return host, path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def _features_py(url: str | None) -> list[int]:
    out = []
    for text, salt in zip(_host_path_py(url), (HOST_SALT, PATH_SALT)):
        codes = [ord(c) for c in f"^^{text}$$"]
        out += [(codes[i] * 961 + codes[i + 1] * 31 + codes[i + 2] + salt * 7919) % BUCKETS for i in range(len(codes) - 2)]
    return out


@functools.cache
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, epochs: int = 60, rate: float = 0.1, decay: float = 1e-2) -> tuple[int, tuple[int, ...]]:
    """(bias, weights) in millionths, by stochastic gradient steps in the table's order."""
    rows = [(_features_py(url), y) for url, y in labelled]
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        for features, y in rows:
            z = bias + sum(weights[f] for f in features)
            step = rate * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += step
            for f in features:
                weights[f] += step - rate * decay * weights[f]
    return round(bias * 1e6), tuple(round(w * 1e6) for w in weights)


def _score(host: Column, path: Column, model: tuple[int, tuple[int, ...]]) -> Column:
    bias, weights = model
    table = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<bigint>)")

    def part(text: Column, salt: int) -> Column:
        s = F.concat(F.lit("^^"), text, F.lit("$$"))

        def code(i: Column) -> Column:
            return F.ascii(F.substring(s, i, F.lit(1))).cast("long")

        def weight(i: Column) -> Column:
            return F.get(table, F.pmod(code(i) * 961 + code(i + 1) * 31 + code(i + 2) + F.lit(salt * 7919), F.lit(BUCKETS)).cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.length(s) - 2), F.lit(0).cast("long"), lambda total, i: total + weight(i))

    return F.lit(bias).cast("long") + part(host, HOST_SALT) + part(path, PATH_SALT)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    known = F.instr(url, "://") > 0
    host = F.when(known, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")
    return host, F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score for each row.

    A rule ``host/path`` fits its host and all subdomains where the url's path
    starts with the rule's; the longest that fits decides (of equal lengths, the
    smaller string), else the model: block where score > 0. Null urls and urls
    without ``://`` have an empty host and path and are judged by the model on
    those. Repeated rows are judged each; null ids stay; other columns are
    ignored; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    t = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    t = t.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at, _, rest = text.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    t = t.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _score(F.col("host"), F.col("path"), train(tuple(labelled))).alias("score"))
    judged = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return t.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")


def oracle() -> str:
    """The same rows in DuckDB SQL, with the trained weights written out."""
    bias, weights = train()

    def part(text: str, salt: int) -> str:
        s = f"('^^' || {text} || '$$')"
        code = "unicode(substr({s}, i + {j}, 1))::BIGINT"
        return f"list_sum([w[1 + ({code.format(s=s, j=0)} * 961 + {code.format(s=s, j=1)} * 31 + {code.format(s=s, j=2)} + {salt * 7919}) % {BUCKETS}] FOR i IN range(1, length({s}) - 1)])"

    case = " ".join(
        f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{{0}}{t}'".replace("{0}", f"{kind} ")
        for kind, t in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    )
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), scored AS (
  SELECT u.page_id, host, path, CASE {case} END AS fit,
         ({bias} + {part('host', HOST_SALT)} + {part('path', PATH_SALT)})::BIGINT AS score
  FROM urls u, (SELECT {list(weights)}::BIGINT[] AS w)
)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score
FROM scored"""
