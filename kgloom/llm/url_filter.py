"""URL verdicts: host and path rules, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The labelled table: invented URLs, 1 to block.
BLOCKED = """
http://free-casino-bonus.bid/slots/win?ref=1 http://poker-jackpot.club/play/now https://best-casino.top/spin/bonus
http://cheap-pills-online.top/buy/viagra https://pharma-discount.bid/pills/order http://rx-pills.click/cheap/meds
http://adult-cams.club/xxx/live https://xxx-videos.top/porn/hd http://hot-singles.click/adult/chat
http://torrent-crack.top/download/keygen https://warez-files.club/crack/serial http://keygen-free.bid/download/crack
http://click-tracker.click/ads/redirect?to=1 https://ad-banner.bid/ads/pop http://popads.top/click/redirect
http://seo-links.club/spam/backlinks https://buy-followers.top/spam/likes http://link-farm.bid/seo/links
http://win-iphone.click/prize/claim https://lottery-winner.top/claim/prize http://free-gift-card.bid/win/claim
http://login-secure-bank.top/verify/account https://account-verify.click/login/update http://paypa1-login.bid/secure/verify
http://crypto-doubler.top/invest/bonus https://quick-loan.club/apply/cash http://forex-profit.bid/invest/now
http://192.0.2.7/payload.exe http://198.51.100.9/bin/malware.exe http://malware-host.top/drop/setup.exe
""".split()
ALLOWED = """
https://www.city-library.org/catalogue/books https://library.example.edu/books/history http://archive.museum.org/collections/art
https://news.daily-herald.org/2020/05/article.html https://www.times.org/world/article/123 http://gazette.org/local/news
https://docs.project.org/en/latest/guide.html https://wiki.project.org/page/Main http://manual.software.org/reference/index.html
https://www.university.edu/research/paper.pdf https://physics.college.edu/course/notes.html http://school.edu/lessons/algebra
https://recipes.kitchen.org/soup/tomato https://garden.org/plants/roses http://cooking.org/bread/recipe.html
https://en.encyclopedia.org/wiki/Mountain https://de.encyclopedia.org/wiki/Berg http://fr.encyclopedia.org/wiki/Montagne
https://health.clinic.org/advice/sleep https://hospital.org/patients/information http://weather.gov/forecast/today
https://blog.travel.org/de/berlin https://photos.nature.org/birds/heron http://trains.org/timetable/2020
https://forum.programming.org/thread/512 https://code.project.org/tutorial/python http://science.org/journal/article
https://parks.gov/visit/maps https://statistics.gov/data/census http://www.parliament.gov/bills/current
""".split()

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_END = re.compile(r"[/?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null url or one without ://."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _END.search(rest)
    host = (rest[: m.start()] if m else rest).translate(_LOWER)
    path = rest[m.start() :] if m else ""
    return host, re.split(r"[?#]", path, maxsplit=1)[0]


def features(host: str, path: str) -> tuple[np.ndarray, float]:
    """Buckets of the distinct character n-grams of host and path, and the weight of each."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode("utf-8", "replace")
        for n in GRAMS:
            found |= {zlib.crc32(raw[k : k + n], ord(mark)) % BUCKETS for k in range(len(raw) - n + 1)}
    at = np.array(sorted(found), np.int64)
    return at, 1 / np.sqrt(max(1, len(at)))


def train(labelled: list[tuple[str, int]], rounds: int = 400, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the intercept last, by gradient descent over the whole small table."""
    x = np.zeros((len(labelled), BUCKETS + 1))
    for row, (url, _) in zip(x, labelled):
        at, w = features(*split_url(url))
        row[at] = w
        row[-1] = 1
    y, beta = np.array([v for _, v in labelled], float), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta -= rate * (x.T @ (p - y) / max(1, len(y)) + ridge * beta)
    return beta


def longest_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits. rules: by host, of (path, verdict)."""
    best, at = None, 0
    while host and at >= 0:
        own = host[at:]
        for start, verdict in rules.get(own, ()):
            if path.startswith(start) and (best is None or len(own + start) > len(best[0])):
                best = (own + start, verdict)
        at = host.find(".", at) + 1 or -1
    return best


def judge_urls(
    df: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    labelled: list[tuple[str, int]] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; rule is null where the model decides.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
    score is the model's probability to block, whichever decides. Null urls and urls without ://
    have an empty host and path and are left to the model. Repeated rows are judged alike; an
    empty table gives no rows; other columns are ignored. The model is trained on the driver from
    the labelled table (default: BLOCKED and ALLOWED), which must be small. No exchange.
    """
    beta = train(labelled or [*((u, 1) for u in BLOCKED), *((u, 0) for u in ALLOWED)])
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    schema = T.StructType(
        [
            df.schema[key],
            *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                host, path = split_url(x)
                at, w = features(host, path)
                score = float(1 / (1 + np.exp(-(w * beta[at].sum() + beta[-1]))))
                rule, verdict = longest_rule(host, path, by_host) or (None, "block" if score >= threshold else "allow")
                out.append((host, path, rule, verdict, score))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names
            )

    return df.select(F.col(key), F.col(url).cast("string")).mapInArrow(run, schema)
