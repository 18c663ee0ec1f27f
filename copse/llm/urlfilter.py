"""URL filter: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

A url is judged by the longest rule that fits it: a rule `host/path` fits its host and all subdomains if the url's path
starts with the rule's path. Where no rule fits, the vocabulary decides: terms count only between characters that are
no letters or digits, and a url is blocked from a summed weight of BLOCK on: one strict term, or several different soft
terms. VOCABULARY is the default; load_vocabulary() reads another one from a table.

Defined results: of rules of equal length that fit, which have equal hosts and paths, the first one given wins; a null url, or one without `://`, has an empty host and path, and only the vocabulary can block it
(null: allow); whole urls are read, however long; of terms given twice, the last weight counts; repeated rows are judged alike; an empty table gives an empty result; judge() lets further columns
through and replaces columns of the names it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from copse.llm.common import LOWER, UPPER, read, ship

#: Summed weight that blocks, and what a strict and a soft term weigh.
BLOCK = 2
STRICT_WEIGHT, SOFT_WEIGHT = BLOCK, 1
#: Categories with strict and soft terms. Forms such as plurals are terms of their own.
VOCABULARY = {
    "adult": (
        "porn porno pornos pornographic xxx hentai camgirl camgirls sexcam sexcams milf milfs escorts nsfw upskirt",
        "adult adults sex sexy nude nudes naked erotic erotica fetish cam cams webcams hookup hookups escort strip stripper strippers singles",
    ),
    "gambling": (
        "casino casinos roulette blackjack baccarat sportsbook sportsbooks bookmakers",
        "bet bets betting poker slot slots jackpot jackpots bingo lottery lotto wager wagers odds gamble gambling spins bookmaker",
    ),
    "pharmacy": (
        "viagra cialis levitra kamagra sildenafil tadalafil tramadol phentermine xanax",
        "pill pills pharmacy pharmacies meds prescription prescriptions steroid steroids painkillers weightloss rx",
    ),
    "piracy": (
        "warez keygen keygens nulled fullmovie",
        "crack cracks cracked torrent torrents serials leaked repack repacks rips download downloads",
    ),
    "malware": (
        "phishing malware ransomware keylogger keyloggers spyware adware",
        "hack hacks hacked trojan trojans cheats popup popups toolbars",
    ),
    "spam": (
        "linkfarm linkfarms spamming doorway",
        "spam spammer ads track tracker trackers tracking affiliate affiliates promo promos clickbait cheap free winner winners prize prizes loan loans payday bonus bonuses coupons backlink backlinks replica replicas",
    ),
}
#: Most terms that load_vocabulary() takes to the driver.
MAX_TERMS = 1_000_000
Term = tuple[str, int, str]


def default_terms() -> list[Term]:
    """(term, weight, category) of VOCABULARY."""
    return [(t, w, c) for c, lists in VOCABULARY.items() for w, terms in zip((STRICT_WEIGHT, SOFT_WEIGHT), lists, strict=True) for t in terms.split()]


#: Decision, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_TO_LOWER = str.maketrans(UPPER, LOWER)
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_TO_LOWER), _PATH.match(url, host.end())[0]


class Judge:
    def __init__(self, rules=RULES, terms: list[Term] | None = None, block: int = BLOCK) -> None:
        self.block = block
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.automaton = ahocorasick.Automaton()
        for term, weight, category in default_terms() if terms is None else terms:
            if term:
                term = term.translate(_TO_LOWER)
                self.automaton.add_word(term, (term, weight, category))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as host and path, and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        at = 0 if host else -1
        while at >= 0:
            for p, verdict in self.rules.get(host[at:], ()):
                if path.startswith(p) and (best[0] is None or len(host) - at + len(p) > len(best[0])):
                    best = (host[at:] + p, verdict)
            at = host.find(".", at) + 1 or -1
        return best

    def hits(self, url: str) -> dict[str, tuple[int, str]]:
        """Weight and category of each different term that stands in a url between boundaries."""
        found: dict[str, tuple[int, str]] = {}
        text = url.translate(_TO_LOWER)
        if len(self.automaton):
            for end, (term, weight, category) in self.automaton.iter(text):
                a, b = end - len(term), end + 1
                if (a < 0 or not text[a].isalnum()) and (b >= len(text) or not text[b].isalnum()):
                    found[term] = weight, category
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """Host, path, rule, verdict and, if the vocabulary blocks, the categories that it found."""
        host, path = parts(url)
        rule, verdict = self.rule(host, path)
        if verdict:
            return host, path, rule, verdict, None
        found = self.hits(url or "")
        if sum(w for w, _ in found.values()) < self.block:
            return host, path, None, "allow", None
        return host, path, None, "block", ",".join(sorted({c for _, c in found.values()}))


def load_vocabulary(spark: SparkSession, path: str) -> list[Term]:
    """The terms of a Parquet table (term, weight, category), for judge(). More than MAX_TERMS are an error; rows without a term or weight are left out."""
    rows = spark.read.parquet(path).select("term", "weight", "category").filter("term IS NOT NULL AND weight IS NOT NULL").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return sorted((r["term"], int(r["weight"]), r["category"] or "") for r in rows)


ADDED = ("host", "path", "rule", "verdict", "categories")


def judge(pages: DataFrame, url: str = "url", **settings) -> DataFrame:
    """pages with host, path, rule, verdict and categories; settings as of Judge. The terms go to every task once."""
    ship(pages.sparkSession)
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ADDED and c != url])
    schema = T.StructType([*pages.schema.fields, *[T.StructField(c, T.StringType()) for c in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.urlfilter import ADDED, Judge

        judge_ = Judge(**settings)
        for b in batches:
            rows = [judge_.judge(u) for u in b.column(b.schema.get_field_index(url)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[i] for r in rows], pa.string()) for i in range(len(ADDED))]], [*b.schema.names, *ADDED])

    return pages.mapInArrow(run, schema)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", *ADDED[:4])


def _sql() -> str:
    """All terms are words of letters and digits, so they stand between boundaries where they are words of the url."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    terms = {w: ", ".join(f"'{t}'" for t, x, _ in default_terms() if x == w) for w in (STRICT_WEIGHT, SOFT_WEIGHT)}
    weight = " + ".join(f"{w} * len(list_intersect(words, [{ts}]))" for w, ts in terms.items())
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
             list_distinct(regexp_split_to_array(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[^\\p{{L}}\\p{{N}}]+')) AS words,
             translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(v, h, p) AS (VALUES {rules}),
fits AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {weight} >= {BLOCK} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (r)
"""


ORACLE = _sql()
