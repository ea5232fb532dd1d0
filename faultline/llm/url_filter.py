"""URL filters: listed rules, and naive Bayes over segmented host and path words.

A rule is ``host/path-prefix``; it fits the host and its subdomains, and the longest
rule that fits decides.  Other urls are scored: a unigram Viterbi search splits the
runs of letters in host and path into words, and a multinomial naive Bayes model adds
up the words' log odds.

Word frequencies come half from the labelled examples and half from delimited words of
the whole table: words of the pages' text, where there is one, segments of paths, and
parts of names with a hyphen.  A name in one run is never a word because it is a name,
and its own entry does not count where words of ``LEAST_PART`` letters or more, each at
least as frequent, make it up.  A word counts from
two hosts and a share of ``LEAST_SHARE`` of all words on, which bounds the table by
1 / LEAST_SHARE words at any size.  A word that reads as labelled words, and
others at least as frequent as itself, is split however often it is used.  The classes
come from the labelled examples, a bounded parameter.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule
and gets the verdict of the prior; runs of letters of any length are split whole; a null
page text has no words; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .workspace import Workspace

#: Labelled examples (fixed values): hosts and paths of each class.
EXAMPLES = {
    "block": (
        "casino-win.example", "cheap-pills.example", "spam-farm.example", "free-casino-bonus.example", "online-casino-poker.example", "win-money-fast.example", "buy-cheap-pills-online.example",
        "adult-porn-videos.example", "hot-sex-cams.example", "pharmacy-discount-pills.example", "viagra-cialis-cheap.example", "lottery-prize-winner.example", "payday-loans-fast-cash.example", "ads-track.example", "ad-tracker-banner-ads.example", "free-bets-odds.example", "sports-bets-win.example", "adult-x.example", "cheap-meds-online.example", "free-prizes-win.example",
        "free-casino.example", "online-poker-bonus.example", "casino-slots-jackpot.example", "bet-online-casino.example", "poker-slots-free-bets.example", "sports-betting-odds.example", "bet-win-odds.example", "jackpot-lottery-win.example", "lottery-cash-prize.example",
        "win-cash-prizes.example", "fast-cash-payday-loans.example", "instant-payday-cash.example", "easy-money-fast-win.example", "cheap-viagra-pharmacy.example", "discount-cialis-pills.example", "pharmacy-meds-discount.example", "buy-viagra-pills.example", "miracle-diet-pills.example",
        "weight-loss-diet-pills.example", "adult-sex-videos.example", "hot-adult-cams.example", "xxx-porn-videos.example", "sex-cams-xxx.example", "porn-cams-free.example", "fake-watches-cheap.example", "replica-watches-discount.example", "replica-fake-bags-cheap.example",
        "crack-warez-download.example", "keygen-crack-warez.example", "warez-keygen-free-download.example", "seo-link-spam.example", "spam-seo-link-farm.example", "click-bait-ads.example", "banner-ads-click.example", "popup-ads-banner-tracker.example", "ad-click-tracker.example",
        "link-farm-seo-spam.example", "click-bait-farm.example", "free-download-crack-warez.example", "fake-replica-watches.example", "bet-slots-jackpot.example", "miracle-weight-loss-pills.example", "xxx-adult-chat.example",
    ),
    "allow": (
        "news.example", "docs.example", "free-library-books.example", "cycle-track-club.example", "wiki.example", "library.example", "university-press.example", "school.example", "science-journal.example",
        "library-books-archive.example", "history-books-review.example", "science-news-review.example", "university-science-library.example", "school-history-project.example", "open-science-journal.example", "city-library-news.example", "travel-weather-guide.example", "city-travel-guide.example",
        "food-health-guide.example", "health-news-report.example", "music-school-course.example", "online-school-course.example", "museum-archive-guide.example", "bank-service-help.example", "farm-food-market.example", "world-history-museum.example", "software-project-docs.example", "free-online-course.example", "sports-club-news.example",
        "city-council.example", "open-source-project.example", "museum-history.example", "weather-report.example", "travel-guide.example", "food-recipes.example", "health-service.example", "bank-account-help.example",
        "farm-equipment-supply.example", "free-software-foundation.example", "world-cup-winner-report.example", "online-course.example", "book-review.example", "music-archive.example", "index.html", "page/article", "about/contact",
    ),
}
#: A word's least share of all words, the examples' share of the table, smoothing of the model, prior of blocking, shortest part of a compound.
LEAST_SHARE, EXAMPLE_SHARE, SMOOTHING, PRIOR_BLOCK, LEAST_PART = 1e-6, 0.5, 1.0, 0.2, 3
#: Pages whose text is cleaned at once.
PAGES = 256
#: Markup and urls of a page; every alternative ends at the next opening bracket or at the text's end, so no text is read twice.
MARKUP = re.compile(rb"(?is)<(script|style)\b[^<>]*>.*?(?:</\1>|\Z)|<[^<>]*>|https?://\S*")
NO_LETTER = re.compile(rb"[^a-z]+")
#: True for bytes that words of letters must not touch, and for those of the words.
_JOINED, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_JOINED[[0x2D, 0x5F, *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words that say nothing about the class (fixed values).
NEUTRAL = frozenset(("www", "m", "blog", "x", "example", "com", "net", "org", "html", "htm", "php", "index", "http", "https"))

JUDGED = "host string, path string, rule string, verdict string, score double, words array<string>"


def host_of(url):
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url):
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def runs(text: str) -> list[str]:
    return re.findall("[a-z]+", text.lower())


@dataclass
class Rules:
    """Rules by host; the longest rule that fits wins."""

    by_host: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)  # host: (path, rule, verdict)

    @classmethod
    def of(cls, rules: Sequence[tuple[str, str]]) -> "Rules":
        out = cls()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            out.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        return out

    def candidates(self, host: str) -> list[tuple[str, str, str]]:
        """Rules of the host and the domains above it, longest first."""
        labels = host.split(".")
        found = [r for i in range(len(labels)) for r in self.by_host.get(".".join(labels[i:]), ())]
        return sorted(found, key=lambda r: (-len(r[1]), r[1]))


@dataclass
class Model:
    """Unigram costs for segmentation and log odds for blocking."""

    costs: dict[str, float]
    unknown: float
    odds: dict[str, float]
    prior: float
    longest: int = 0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.costs), default=0)

    def segment(self, run: str, name: bool = False) -> list[str]:
        """Cheapest split of a run of letters; an unknown sequence of n letters costs unknown * (1 + n).  name: the run is part of a host, and more frequent words that make it up go before its own entry."""
        own = self.costs.get(run)
        if name and own is not None:
            parts = self._cheapest(run, lambda w: self.costs.get(w, math.inf) if LEAST_PART <= len(w) < len(run) and self.costs.get(w, math.inf) <= own else None, math.inf)
            if parts:
                return parts
        return self._cheapest(run, self.costs.get, self.unknown)

    def _cheapest(self, run: str, cost_of: Callable[[str], float | None], unknown: float) -> list[str]:
        """Viterbi search; no split where known words don't cover the run and unknown ones cost without end."""
        best, back = [0.0], [0]
        start = 0  # of the best unknown sequence that ends here
        free = math.isfinite(unknown)
        for i in range(1, len(run) + 1):
            cost, at = math.inf, 0
            if free:
                if best[i - 1] - unknown * (i - 1) < best[start] - unknown * start:
                    start = i - 1
                cost, at = best[start] + unknown * (1 + i - start), start
            for j in range(max(0, i - self.longest), i):
                known = cost_of(run[j:i])
                if known is not None and best[j] + known < cost:
                    cost, at = best[j] + known, j
            best.append(cost)
            back.append(at)
        words, i = [], len(run) if math.isfinite(best[-1]) else 0
        while i:
            words.append(run[back[i] : i])
            i = back[i]
        return words[::-1]

    def score(self, words: Sequence[str]) -> float:
        """Probability of blocking."""
        z = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def compounds(counts: dict[str, int], labelled: set[str]) -> set[str]:
    """Words that read as several: one of them labelled, the others labelled or at least as frequent as the whole."""
    inside = re.compile("|".join(sorted(re.escape(w) for w in labelled if len(w) >= LEAST_PART)) or "(?!)")
    out = set()
    for word, n in counts.items():
        if word in labelled or not inside.search(word):
            continue
        read: list[int] = [1] + [0] * len(word)  # bit 0: read as words up to here, bit 1: with a labelled one
        for i in range(LEAST_PART, len(word) + 1):
            for j in range(i - LEAST_PART + 1):
                part = word[j:i]
                if read[j] and part != word:
                    if part in labelled:
                        read[i] |= 2
                    elif counts.get(part, 0) >= n:
                        read[i] |= read[j]
        if read[-1] & 2:
            out.add(word)
    return out


def fit(counts: dict[str, int], examples: dict[str, Sequence[str]] = EXAMPLES, prior_block: float = PRIOR_BLOCK) -> Model:
    """counts: occurrences of words in the corpus."""
    words = {c: Counter(w for text in examples[c] for w in runs(text) if w not in NEUTRAL) for c in ("block", "allow")}
    labelled = words["block"] + words["allow"]
    split = compounds(counts, set(labelled))
    table = {w: n for w, n in counts.items() if w not in split}
    total, size = sum(table.values()), sum(labelled.values())
    share = (EXAMPLE_SHARE if total else 1.0) if size else 0.0
    chance = {w: (1 - share) * n / total for w, n in table.items()}
    for w, n in labelled.items():
        chance[w] = chance.get(w, 0.0) + share * n / size
    costs = {w: 1 - math.log(p) for w, p in chance.items()}
    vocabulary = labelled.keys()
    sizes = {c: sum(words[c].values()) + SMOOTHING * len(vocabulary) for c in words}
    odds = {w: math.log((words["block"][w] + SMOOTHING) / sizes["block"]) - math.log((words["allow"][w] + SMOOTHING) / sizes["allow"]) for w in vocabulary}
    return Model(costs, math.log(total + size + 1) / 2 + 1, odds, math.log(prior_block / (1 - prior_block)))


def page_words(host: str | None, path: str | None, text: str | None) -> bytes:
    """Delimited words of a page: of its text without markup and urls, of its path, and of names with a hyphen."""
    names = " ".join(x for x in (host or "").split(".") if "-" in x)
    return b" ".join((NO_LETTER.sub(b" ", f"{names} {path or ''}".lower().encode()), MARKUP.sub(b" ", (text or "").encode()).lower()))


def word_counts(pages: DataFrame, url: str = "url", text: str = "html", least_share: float = LEAST_SHARE) -> dict[str, int]:
    """Occurrences of delimited words that two hosts or more use, over the whole table.

    Words are counted in each block before the shuffle, with the least and the greatest
    hash of a host, which differ where a word has several hosts.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
            hosts = batch.column(3).to_numpy()
            bodies = pa.array([page_words(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)))], pa.large_binary()).view(pa.large_string())
            for row, data, offsets in ts.blocks(bodies):
                starts, ends, first = ts.words(data, offsets, _JOINED)
                other = np.concatenate([[0], np.cumsum(~_LETTER[data])])
                plain = other[starts] == other[ends]
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[plain] + row
                starts, ends = starts[plain], ends[plain]
                key, at, place, n = np.unique(ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[data]), starts, ends), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order], np.arange(len(key)))
                mine = hosts[owner[order]]
                low, high = (f.reduceat(mine, edges) if len(key) else mine for f in (np.minimum, np.maximum))
                a, b = starts[at], ends[at]
                bounds = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
                words = pa.LargeStringArray.from_buffers(len(key), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[ts.ragged(a, b - a)].tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(low), pa.array(high)], names=["w", "n", "low", "high"])

    body = F.col(text) if text in pages.columns else F.lit(None).cast("string")
    rows = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)), body).select("*", F.xxhash64("host"))
    used = rows.mapInArrow(tally, "w string, n long, low long, high long").groupBy("w").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    used = Workspace(pages.sparkSession, "url-filter").table("words", used)
    total = used.agg(F.sum("n")).first()[0] or 0
    got = used.where((F.col("low") != F.col("high")) & (F.col("n") >= least_share * total)).select("w", "n").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", model: Model | None = None, text: str = "html") -> DataFrame:
    """key, host, path, rule, verdict (allow or block), score of blocking and segmented words."""
    model = fit(word_counts(pages, url, text)) if model is None else model
    rows = pages.select(F.col(key), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast((model, Rules.of(rules)))
    kind = rows.schema[key].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rules = shared.value
        for batch in batches:
            known: dict[tuple[str, bool], list[str]] = {}
            fitting: dict[str, list[tuple[str, str, str]]] = {}
            out: list[tuple] = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if host not in fitting:
                    fitting[host] = rules.candidates(host)
                words: list[str] = []
                for run, name in [(r, True) for r in runs(host)] + [(r, False) for r in runs(path)]:
                    if (run, name) not in known:
                        known[run, name] = model.segment(run, name)
                    words += known[run, name]
                score = model.score(words)
                _, rule, verdict = next((r for r in fitting[host] if path.startswith(r[0])), (None, None, "block" if score > 0.5 else "allow"))
                out.append((rule, verdict, score, words))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[key, "host", "path", "rule", "verdict", "score", "words"])

    return rows.mapInArrow(rate, f"`{key}` {kind}, {JUDGED}")
