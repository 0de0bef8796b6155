"""URL filter: host and path rules, then a weighted vocabulary of URL terms.

An Aho-Corasick automaton finds every term of the vocabulary in the lower-cased
url; a hit counts if neither neighbour is a letter or digit. One strict term
rejects the url, and so do ``SOFT_LEAST`` distinct soft terms or more, of as
many distinct stems, if these weigh ``SOFT_LIMIT`` together. A stem weighs once,
however often and in whatever form it comes: its plural is the same stem, and a
compound is one term of two stems, so no single soft term rejects.
A rule (host, path) fits its host and all subdomains where the path starts with
the rule's; the longest fitting rule decides before the vocabulary does.

The vocabulary is a parameter: a list of strict terms, and soft stems with their
weights, or a table of both (``read_vocabulary``). No weight reaches the limit
on its own (``soft_vocabulary`` refuses it). The standard one is made by a rule
from short lists of stems: their plurals, and all compounds of two of them, some
thousands of terms. Its automaton is built once a task.

A null url, or one without ``://``, has an empty host and path and fits no
rule; the vocabulary still reads what there is of it. Urls are read whole, of
any length, in one pass. Rows keep page_id as it is, null or repeated; repeated
rows are judged alike. Of rules that fit with the same length (the same host
and path twice) the first listed decides. Columns other than page_id and url
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_rows, slices

Rule = tuple[str, str, str]  # verdict, host, path

#: Fixed values of the query: verdict, host, path.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Stems of which one rejects, and those that count by weight.
STRICT_STEMS = ("casino", "escorts", "hentai", "porn", "pornhub", "spamfarm", "viagra", "warez", "xxx")
STRICT_EXTRA = ("adult-x", "free-bets", "spam-farm")
SOFT_STEMS = {
    "adult": 1.0, "ads": 0.5, "bet": 1.0, "bonus": 0.5, "cheap": 0.5, "crack": 1.0, "dating": 0.5, "escort": 1.0,
    "farm": 0.25, "free": 0.5, "keygen": 1.0, "loan": 0.5, "nude": 1.0, "payday": 1.0, "pills": 1.0, "poker": 1.0,
    "sex": 1.0, "slots": 1.0, "spam": 1.0, "torrent": 1.0, "track": 0.5, "win": 0.5,
    "cams": 1.0, "chat": 0.25, "coupon": 0.25, "deals": 0.25, "diet": 0.5, "erotic": 1.0, "fetish": 1.0, "gambling": 1.0,
    "hookup": 1.0, "jackpot": 1.0, "lottery": 0.5, "milf": 1.0, "naked": 1.0, "roulette": 1.0, "serial": 0.25, "singles": 0.5,
    "steroids": 1.0, "betting": 1.0,
}
#: What soft stems have to weigh together, and how many of them there have to be.
SOFT_LIMIT, SOFT_LEAST = 1.5, 2


def soft_vocabulary(stems: dict[str, float] = SOFT_STEMS, limit: float = SOFT_LIMIT) -> dict[str, tuple[str, ...]]:
    """The stems that each soft term counts for: a stem and its plural for itself, compounds of two for both. (Two stems with a hyphen are found as they are.)"""
    if heavy := [s for s, x in stems.items() if x >= limit]:
        raise ValueError(f"a single soft term would reject: {heavy[0]}")
    out: dict[str, tuple[str, ...]] = {}
    for a, b in ((a, b) for a in stems for b in stems if a != b):
        pair = tuple(sorted((a, b)))
        out[a + b] = min(out.get(a + b, pair), pair)
    out |= {f"{a}s": (a,) for a in stems if not a.endswith("s")}
    return out | {a: (a,) for a in stems}


def strict_terms(stems: Sequence[str] = STRICT_STEMS, extra: Sequence[str] = STRICT_EXTRA) -> tuple[str, ...]:
    """Stems, their plurals, compounds of two, and what is listed as it is."""
    plural = [f"{a}s" for a in stems if not a.endswith("s")]
    return tuple(sorted({*stems, *extra, *plural, *(f"{a}{joint}{b}" for a in stems for b in stems if a != b for joint in ("", "-"))}))


#: One of these rejects.
STRICT_TERMS = strict_terms()


def read_vocabulary(spark: SparkSession, path: str) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict terms and soft stems of a table (term, weight) in CSV; a term without a weight is strict. A vocabulary fits the driver and each task."""
    rows = spark.read.schema("term string, weight double").csv(path).where("term IS NOT NULL AND term <> ''").collect()
    strict = {r["term"].lower() for r in rows if r["weight"] is None}
    return tuple(sorted(strict)), {r["term"].lower(): r["weight"] for r in rows if r["weight"] is not None and r["term"].lower() not in strict}


SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_stems int, soft_weight double"
_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def by_host(rules: Sequence[Rule]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules of each host, longest path first."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        out.setdefault(host, []).append((path, host + path, verdict))
    for found in out.values():
        found.sort(key=lambda r: -len(r[0]))
    return out


def fit_rule(hosts: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """Name and verdict of the longest rule that fits."""
    best = None
    while host:
        for start, name, verdict in hosts.get(host, ()):
            if path.startswith(start) and (best is None or len(name) > len(best[0])):
                best = name, verdict
        host = host.partition(".")[2]
    return best


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: dict[str, float] = SOFT_STEMS,
    soft_limit: float = SOFT_LIMIT,
    soft_least: int = SOFT_LEAST,
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, distinct strict and soft terms, and distinct soft stems with their weight."""
    # A strict term has no stems.
    stems_of = soft_vocabulary(soft, soft_limit) | dict.fromkeys(strict, ())
    hosts = by_host(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for term in stems_of:
            terms.add_word(term, term)
        terms.make_automaton()

        def hits(url: str) -> set[str]:
            found, last = set(), len(url) - 1
            for end, term in terms.iter(url):
                start = end - len(term)
                if not (start >= 0 and url[start].isalnum() or end < last and url[end + 1].isalnum()):
                    found.add(term)
            return found

        for pdf in slices(batches):
            rows = []
            for page_id, url in zip(pdf["page_id"], pdf["url"], strict=True):
                url = url if isinstance(url, str) else ""
                host, path = split_url(url)
                found = hits(url.lower()) if stems_of else set()
                n_strict = sum(not stems_of[t] for t in found)
                stems = {s for t in found for s in stems_of[t]}
                weight = sum(soft[s] for s in sorted(stems))
                rule = fit_rule(hosts, host, path)
                verdict = rule[1] if rule else "block" if n_strict or min(len(found) - n_strict, len(stems)) >= soft_least and weight >= soft_limit else "allow"
                rows.append((page_id, host, path, rule and rule[0], verdict, n_strict, len(found) - n_strict, len(stems), weight))
            yield pd.DataFrame(rows, columns=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_stems", "soft_weight"])

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), judge, SCHEMA, "page_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in RULES)
    soft = ", ".join(f"({quoted(t)}, {w})" for t, w in SOFT_STEMS.items())
    strict = ", ".join(f"({quoted(t)})" for t in STRICT_STEMS)
    extra = ", ".join(f"({quoted(t)})" for t in STRICT_EXTRA)
    return f"""
WITH rules(r_verdict, r_host, r_path) AS (VALUES {rules}),
soft_stems(t, w) AS (VALUES {soft}), strict_stems(t) AS (VALUES {strict}), joints(j) AS (VALUES (''), ('-')),
strict AS (
  SELECT t FROM strict_stems UNION SELECT t || 's' FROM strict_stems WHERE NOT ends_with(t, 's') UNION SELECT * FROM (VALUES {extra})
  UNION SELECT a.t || j || b.t FROM strict_stems a, strict_stems b, joints WHERE a.t <> b.t
), forms AS (
  -- A stem counts as itself though it may be the plural or a compound of others.
  SELECT t, stems, row_number() OVER (PARTITION BY t ORDER BY k, stems) AS nth FROM (
    SELECT t, [t] AS stems, 1 AS k FROM soft_stems UNION ALL SELECT t || 's', [t], 2 FROM soft_stems WHERE NOT ends_with(t, 's')
    UNION ALL SELECT a.t || b.t, list_sort([a.t, b.t]), 3 FROM soft_stems a, soft_stems b WHERE a.t <> b.t
  ) WHERE t NOT IN (SELECT t FROM strict)
), vocabulary AS (SELECT t, stems, 0 AS strict FROM forms WHERE nth = 1 UNION ALL SELECT t, [], 1 FROM strict),
u AS (
  SELECT page_id, lower(coalesce(url, '')) AS l,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), runs AS (
  -- A term between other characters than letters and digits is a whole run of them, or two with a hyphen.
  SELECT page_id, string_split(unnest(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*')), '-') AS parts FROM u
), found AS (
  SELECT page_id, unnest(parts) AS t FROM runs UNION SELECT page_id, unnest([parts[i] || '-' || parts[i + 1] FOR i IN range(1, len(parts))]) FROM runs
), stems_found AS (SELECT DISTINCT page_id, unnest(stems) AS t FROM found JOIN vocabulary USING (t)),
hits AS (
  SELECT page_id, strict_hits, soft_hits, coalesce(soft_stems, 0) AS soft_stems, coalesce(soft_weight, 0) AS soft_weight
  FROM (SELECT page_id, sum(strict) AS strict_hits, sum(1 - strict) AS soft_hits FROM found JOIN vocabulary USING (t) GROUP BY page_id)
  LEFT JOIN (SELECT page_id, count(*) AS soft_stems, sum(w) AS soft_weight FROM stems_found JOIN soft_stems USING (t) GROUP BY page_id) USING (page_id)
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path,
    coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_stems, 0) AS soft_stems, coalesce(soft_weight, 0) AS soft_weight
  FROM u LEFT JOIN hits USING (page_id)
), k AS (
  SELECT s.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS rn
  FROM s LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule,
  coalesce(r_verdict, CASE WHEN strict_hits > 0 OR least(soft_hits, soft_stems) >= {SOFT_LEAST} AND soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS INT) AS strict_hits, CAST(soft_hits AS INT) AS soft_hits, CAST(soft_stems AS INT) AS soft_stems, CAST(soft_weight AS DOUBLE) AS soft_weight
FROM k WHERE rn = 1
"""


OP2_SQL = _sql()
