"""URL judgement: domain rules first, then a weighted vocabulary found with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Terms that reject a URL alone, and terms of which several different ones do.
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "hentai", "jackpot", "gambling")
SOFT = (
    "adult", "bet", "bets", "betting", "bonus", "cheap", "deal", "dating", "free", "hot", "loan", "loans", "pill",
    "pills", "poker", "replica", "sex", "slots", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, field))).otherwise(found)
    return found


def term_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """``struct<strict: int, soft: int>``: numbers of *different* terms of each kind in a URL.

    One automaton over all terms scans the lower-cased URL once. A term counts only where neither
    neighbour is a letter or digit. A term in both lists is strict. Null has no hits.
    """
    hard = {t.lower() for t in strict if t}
    mild = {t.lower() for t in soft if t} - hard

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in hard | mild:
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()

        def hits(url: str | None) -> tuple[int, int]:
            if not url or not len(automaton):
                return 0, 0
            text = url.lower()
            seen = set()
            for end, term in automaton.iter(text):
                start = end - len(term) + 1
                if (start == 0 or not text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                    seen.add(term)
            return len(seen & hard), len(seen & mild)

        for urls in batches:
            yield pd.DataFrame([hits(u) for u in urls], columns=["strict", "soft"]).astype("int32")

    return count(url)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``strict_hits``, ``soft_hits``, ``verdict``.

    The longest fitting rule decides; without one, one strict term or ``soft_limit`` different soft
    terms block. Row by row with no shuffle, so hot hosts do not matter.

    Defined cases: a null URL, or one without ``://``, has empty host and path, which no rule fits
    (a rule's path starts with ``/``); a null URL is allowed; long URLs are scanned whole, in time
    linear in them; repeated rows are judged each; an empty table gives an empty result; only id
    and URL are read.
    """
    url = F.col(url_col)
    judged = pages.select(
        F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), term_hits(url, strict, soft).alias("hits")
    )
    host, path = F.col("host"), F.col("path")
    blocked = (F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_limit)
    own = F.when(blocked, "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path",
        rule_for(host, path, rules, "text").alias("rule"),
        F.col("hits.strict").alias("strict_hits"),
        F.col("hits.soft").alias("soft_hits"),
        F.coalesce(rule_for(host, path, rules, "verdict"), own).alias("verdict"),
    )
