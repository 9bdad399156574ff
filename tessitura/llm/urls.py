"""URL filters: prefix rules first, then naive Bayes over host names split into words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, extended, spare, stored

#: Longest word that a split considers, in characters: as long as a label of a host name may be.
LONGEST_WORD = 63

# Labelled host names and paths, from which the classifier learns.
BLOCKED_URLS = (
    "cheap-pills/buy", "cheappills/order", "spam-farm/links", "spamfarm/seo", "casino-win/slots", "casinobonus/play", "free-bets/jackpot", "freebets/odds",
    "ads-track/click", "adstracker/pixel", "adult-x/cams", "adultvideos/xxx", "online-poker/bonus", "pokerroom/win", "payday-loans/apply", "fastloans/cash",
    "buy-viagra/cheap", "viagra-pharmacy/pills", "hot-dating/singles", "sexcams/live", "win-prizes/free", "freemoney/win", "click-bait/ads", "popup-ads/track",
    "link-farm/spam", "replica-watches/cheap", "fake-followers/buy", "betting-tips/casino", "gambling-slots/free", "lottery-win/prize", "miracle-diet/pills", "crypto-scam/double",
    "warez-crack/keygen", "torrent-porn/xxx", "porn-tube/adult", "escort-girls/adult", "malware-download/free", "phishing-login/account",
)
ALLOWED_URLS = (
    "city-library/books", "citylibrary/catalogue", "science-news/articles", "sciencenews/physics", "open-university/courses", "openuniversity/research", "history-museum/exhibits",
    "garden-club/plants", "gardenclub/blog", "music-school/lessons", "musicschool/scores", "weather-report/today", "daily-news/world", "dailynews/politics", "health-service/clinic",
    "public-transport/timetable", "recipes-kitchen/bread", "family-doctor/advice", "code-docs/reference", "codedocs/manual", "travel-guide/cities", "travelguide/maps", "art-gallery/paintings",
    "local-council/services", "bird-watching/notes", "chess-club/games", "river-walks/routes", "maths-notes/proofs", "language-forum/grammar", "book-reviews/novels", "film-archive/cinema",
    "job-centre/careers", "school-lunch/menu", "village-hall/events", "football-club/results", "space-agency/missions", "poetry-journal/issues", "wood-workshop/tools",
)


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Null, or no ``://``: both empty.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    place = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(place, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(place, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, else null. Of rules equally long the first counts."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, *, html: str) -> DataFrame:
    """(word, n) over the visible text of all pages: lower-case Latin words of up to ``LONGEST_WORD`` letters."""
    body = F.regexp_replace(F.lower(f"`{html}`"), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(body, r"[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def name_parts(host: str) -> list[str]:
    """The parts of a host that may be run together words: letters only, without the last label."""
    labels = host.split(".")
    return [x for label in (labels[:-1] or labels) for x in re.split("[^a-z]+", label) if x]


def seed_words(urls: Iterable[str]) -> set[str]:
    return {w for url in urls if "-" in url.split("/")[0] for w in re.split("[^a-z]+", url) if w} | {w for url in urls for w in re.split("[^a-z]+", url.split("/", 1)[1]) if w}


def viterbi(part: str, score: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split of ``part``; a substring outside ``score`` costs ``unknown`` and the more the longer it is."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(part) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = part[start:end]
            options.append((best[start][0] + score.get(word, unknown - 2.5 * len(word)), start))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    words, end = [], len(part)
    while end:
        start = best[end][1]
        words.append(part[start:end])
        end = start
    return words[::-1]


def split_names(names: DataFrame, counts: DataFrame, trusted: dict[str, int]) -> DataFrame:
    """(name, words) of the distinct names: each meets the counts of its own substrings, and is split where it meets them.

    No vocabulary leaves the cluster: a name asks for the counts of its substrings of up to ``LONGEST_WORD`` letters, by a join on the word.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"] + sum(trusted.values())
    ends = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - i + 1)), lambda n: F.substr(F.col("name"), i, n)))
    asked = names.where(F.length("name") > 0).select("name", F.explode(F.array_distinct(F.flatten(ends))).alias("word"))
    known = asked.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("double")))).alias("known"))
    joined = names.join(known, "name", "left")

    def split(batch: pa.RecordBatch) -> list[pa.Array]:
        out, floor = [], math.log(max(total, 1))
        for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True):
            # Words shorter than three letters are mostly fragments of others: their counts are discounted
            score = {w: math.log(n) - floor - (4.0 * (3 - len(w)) if len(w) < 3 else 0.0) for w, n in known or ()}
            score |= {w: math.log(n + math.exp(score.get(w, -700.0) + floor)) - floor for w, n in trusted.items() if w in name}
            out.append(viterbi(name, score, -floor))
        return [pa.array(out, pa.list_(pa.string()))]

    return extended(joined, split, "words array<string>").select("name", "words")


class NaiveBayes:
    """Multinomial, with add-one smoothing; unknown tokens count for neither side."""

    def __init__(self, blocked: Iterable[Iterable[str]], allowed: Iterable[Iterable[str]]) -> None:
        sides = [Counter(t for tokens in x for t in tokens) for x in (blocked, allowed)]
        every = set(sides[0]) | set(sides[1])
        size = [sum(x.values()) + len(every) for x in sides]
        self.weight = {t: math.log((sides[0][t] + 1) / size[0]) - math.log((sides[1][t] + 1) / size[1]) for t in sorted(every)}

    def score(self, tokens: Iterable[str]) -> float:
        """Log odds of block against allow, at even prior odds."""
        return math.fsum(self.weight.get(t, 0.0) for t in tokens)


def train(blocked: Sequence[str] = BLOCKED_URLS, allowed: Sequence[str] = ALLOWED_URLS) -> tuple[NaiveBayes, dict[str, int]]:
    """The classifier, and the words of the labelled urls that a split should trust, with pseudo-counts."""
    trusted = {w: 1000 for w in sorted(seed_words([*blocked, *allowed])) if len(w) > 2}
    score = {w: math.log(n) - 20 for w, n in trusted.items()}

    def tokens(url: str) -> list[str]:
        name, _, path = url.partition("/")
        return [w for part in re.split("[^a-z]+", name) for w in viterbi(part, score, -20)] + [w for w in re.split("[^a-z]+", path) if w]

    return NaiveBayes(map(tokens, blocked), map(tokens, allowed)), trusted


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, corpus: DataFrame, url: str = "url", html: str = "html", blocked: Sequence[str] = BLOCKED_URLS, allowed: Sequence[str] = ALLOWED_URLS) -> DataFrame:
    """Adds host, path, rule, log_odds and verdict to each row of ``pages``.

    The longest fitting rule decides. Else the name parts of the host are split into words by unigram Viterbi, with word counts over the
    visible text of all rows of ``corpus``, and naive Bayes scores these words and the path's: above 0 the verdict is block. The classifier
    learns from ``blocked`` and ``allowed``, urls without scheme. Hosts are split and scored once each, so one host may hold any share of the
    rows; the scores are written down, so that Spark knows their size and broadcasts them if they are few, and else joins them with the rows
    in a join that adaptive execution can split. A null url, or one without
    ``://``, has an empty host and path, no word, log odds 0 and the verdict allow. Repeated rows are judged alike; columns of the new
    names are replaced, all others stay; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    model, trusted = train(blocked, allowed)
    host, path = host_and_path(F.col(f"`{url}`"))
    placed = pages.withColumns({"host": host, "path": path})
    hosts = placed.select("host").distinct()
    parts = F.filter(F.split(F.regexp_replace("host", r"\.[^.]*$", ""), "[^a-z]+"), lambda x: F.length(x) > 0)
    named = hosts.withColumn("parts", parts)
    split = split_names(named.select(F.explode("parts").alias("name")).distinct(), word_counts(corpus, html=html), trusted)
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))
    by_host = named.select("host", F.posexplode("parts").alias("at", "name")).join(split, "name").groupBy("host").agg(words.alias("words"))

    def host_odds(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([model.score(w or ()) for w in batch.column("words").to_pylist()], pa.float64())]

    other, held, fit = (spare(pages, name) for name in ("_host", "_odds", "_rule"))
    scored_hosts = stored(extended(by_host, host_odds, "odds double").where("odds <> 0").select(F.col("host").alias(other), F.col("odds").alias(held)))
    joined = placed.join(scored_hosts, F.col("host") == F.col(other), "left").drop(other)

    def odds(batch: pa.RecordBatch) -> list[pa.Array]:
        own = batch.column(held).fill_null(0.0).to_numpy()
        path = [model.score(x for x in re.split("[^a-z]+", p.lower()) if x) for p in batch.column("path").to_pylist()]
        return [pa.array(own + np.array(path, dtype=np.float64))]

    scored = extended(joined, odds, "log_odds double").drop(held)
    chosen = scored.withColumn(fit, longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return chosen.withColumns({"rule": F.col(f"{fit}.text"), "verdict": verdict}).drop(fit)
