"""URL filtering: rules first, then a logistic regression on hashed character n-grams.

Host and path are cut by SQL expressions. Rules are a short list, so they become
one expression. Urls that no rule fits are judged by a regression trained from a
small labelled table; its weights are an array that travels with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix

#: (verdict, rule), a rule being a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS, ORDERS = 1 << 14, (3, 4, 5)
# Parts that the small labelled table is made of.
_BLOCKED = (
    "casino", "online-casino", "poker-bonus", "pokerstars", "slots", "jackpot", "betting", "sportsbet", "xxx-video", "xxx", "porn", "porntube", "sexcams", "adult-cams", "adult-dating", "escort",
    "cheap-pills", "pills-online", "viagra-shop", "cialis", "pharmacy-discount", "warez", "crack-keygen", "cracked-apps", "keygen", "torrent-free", "torrents", "payday-loan", "fast-loans", "click-bait",
    "free-iphone", "win-prize", "lottery-winner", "crypto-doubler", "replica-watches", "essay-writer",
)
_ALLOWED = (
    "news", "daily-news", "wiki", "wikibooks", "library", "public-library", "university", "college", "museum", "art-museum", "science-daily", "science", "open-docs", "docs", "weather", "recipes", "cooking",
    "city-council", "history", "example", "school", "research", "journal", "garden", "travel-guide", "music-theory", "health-service", "hospital", "bookshop", "football-club", "chess", "maps", "railway",
    "government", "archive", "photography",
)
_HOSTS = ("www.{}.com", "{}.net", "blog.{}.org", "m.{}.example.com", "{}-site.info")
_PATHS_BLOCKED = ("/win-now", "/xxx/free", "/download/crack.exe", "/bonus?ref=1", "/", "/en/cheap-offer")
_PATHS_ALLOWED = ("/en/2024", "/articles/about.html", "/de/index", "/", "/fr/page/12", "/docs/chapter-3.html")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block)."""
    made = []
    for words, paths, label in ((_BLOCKED, _PATHS_BLOCKED, 1), (_ALLOWED, _PATHS_ALLOWED, 0)):
        made += [(f"https://{h.format(w)}{p}", label) for w, h, p in product(words, _HOSTS, paths)]
    return made


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: tuple, value: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own_host, slash, own_path = rule[1].partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (of UTF-8 bytes, ends marked) of all hosts and paths, and the row each belongs to."""
    buckets, owners = [], []
    for mark, texts in ((1, hosts), (2, paths)):
        raw = [b"\x02" + t.encode() + b"\x03" for t in texts]
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        h = np.full(len(b), np.uint64(mark))
        for n in range(1, min(max(ORDERS), len(b)) + 1):
            # h[i] covers n bytes from i on
            h = mix(h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(n))
            if n in ORDERS:
                whole = owner[: len(b) - n + 1] == owner[n - 1 :]
                buckets.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
                owners.append(owner[: len(b) - n + 1][whole])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64), np.empty(0, np.int64))


def train(urls: list[tuple[str, str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (the bias last) from (host, path, label) by full-batch gradient descent; deterministic."""
    at, own = _grams([h for h, _, _ in urls], [p for _, p, _ in urls])
    rows = urls
    y = np.array([label for *_, label in urls], float)
    unit = 1 / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(rows))))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(own, w[at], minlength=len(rows)) * unit + bias)))
        err = p - y
        w -= rate * (np.bincount(at, (err * unit)[own], minlength=BUCKETS) / len(rows) * 20 + decay * w)
        bias -= rate * err.mean()
    return np.append(w, bias)


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability that each url is to be blocked."""
    at, own = _grams(hosts, paths)
    n = np.bincount(own, minlength=len(hosts))
    total = np.bincount(own, weights[at], minlength=len(hosts))
    return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(n, 1)) + weights[-1])))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    return rest[:end].lower(), path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def judge(pages: DataFrame, rules: tuple = RULES, table: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score for each row of pages (page_id, url).

    score is the regression's probability that a url is to be blocked; it decides only
    where no rule fits (rule is null then). A null url, or one without ://, has an empty
    host and path, which no rule fits and which is allowed (score 0). Repeated rows are each judged.
    """
    weights = train([(*_split(u), label) for u, label in (table or labelled_urls())])
    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            host, path = b.column(1).to_pylist(), b.column(2).to_pylist()
            known = np.array([bool(h or x) for h, x in zip(host, path, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(known, scores(weights, host, path), 0.0))], ["page_id", "host", "path", "score"])

    scored = rows.mapInArrow(score, "page_id long, host string, path string, score double")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(_fitting(host, path, rules, 0), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", _fitting(host, path, rules, 1).alias("rule"), verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's verdict by rule or regression."""
    return judge(common.text_sources(spark, sf_dir, "pages"))
