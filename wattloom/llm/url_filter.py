"""URL filters: host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

Rules are decided by DataFrame expressions. Every url also goes once through an automaton of strict and soft terms;
a hit counts when no letter or digit touches it. One strict term or several distinct soft ones reject.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed vocabulary: one strict term rejects; soft terms reject together.
STRICT_TERMS = ("porn", "xxx", "casino", "viagra", "hentai", "escort", "spam-farm", "malware", "phishing", "warez")
SOFT_TERMS = ("adult", "sex", "nude", "poker", "betting", "slots", "jackpot", "loan", "cheap", "pills", "crack", "torrent", "spam", "clickbait", "dating", "hot", "free", "win")
#: Rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _A_Z, _a_z), part(2)


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for heavy, terms in ((True, strict), (False, soft)):
        for t in terms:
            found.add_word(t, (t, heavy))
    found.make_automaton()
    return found


def count_terms(url: str | None, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS) -> tuple[int, int]:
    """Distinct strict and soft terms in a url that no ASCII letter or digit touches."""
    if not url:
        return 0, 0
    url = url.translate(_LOWER)
    hits = {
        (term, heavy) for end, (term, heavy) in _automaton(strict, soft).iter(url)
        if not (end - len(term) >= 0 and _inner(url[end - len(term)])) and not (end + 1 < len(url) and _inner(url[end + 1]))
    }
    return sum(h for _, h in hits), sum(not h for _, h in hits)


_LOWER = str.maketrans(_A_Z, _a_z)


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_limit: int = 2
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, n_strict, n_soft.

    A rule fits its host and the host's subdomains if the path starts with the rule's path; of several the longest
    (host and path together) wins, and the first listed of equally long ones. Without a rule the vocabulary decides:
    ``block`` for one strict term or ``soft_limit`` distinct soft ones, else ``allow``. A null url has empty host and
    path, no rule and is allowed. Other columns are not read; an empty table gives no rows.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict int, n_soft int")
    def terms(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_terms(u, strict, soft) for u in urls], columns=["n_strict", "n_soft"])

    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), terms(url).alias("terms"))
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])
    first = lambda value: F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ranked], F.lit(None).cast("string"))
    scored = F.when((F.col("terms.n_strict") > 0) | (F.col("terms.n_soft") >= soft_limit), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", first(lambda r: r[0] + r[1]).alias("rule"), F.coalesce(first(lambda r: r[2]), scored).alias("verdict"), F.col("terms.n_strict").alias("n_strict"), F.col("terms.n_soft").alias("n_soft")
    )


def url_sql(rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_limit: int = 2) -> str:
    """The same in SQL, one boundary pattern per term."""
    lower = lambda c: f"translate({c}, '{_A_Z}', '{_a_z}')"
    count = lambda terms: " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for t in terms)
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{value(r)}'" for r in ranked) + " END"
    return f"""
        WITH a AS (SELECT page_id, {lower("coalesce(url, '')")} AS u,
                   {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        b AS (SELECT *, CAST({count(strict)} AS INTEGER) AS n_strict, CAST({count(soft)} AS INTEGER) AS n_soft FROM a)
        SELECT page_id, host, path, {case(lambda r: r[0] + r[1])} AS rule,
               coalesce({case(lambda r: r[2])}, CASE WHEN n_strict > 0 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM b"""
