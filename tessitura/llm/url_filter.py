"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A URL that no rule fits is blocked when one strict term, or soft terms of enough summed weight,
stand in it between boundaries.  A boundary is the end of the URL or a character other than
a-z and 0-9 (after A-Z are lower-cased).  Each distinct soft term counts once.

Edge cases: a null URL or one without ``://`` has empty host and path, no rule fits it, and its
text (null: empty) still goes through the vocabulary.  Repeated rows get equal verdicts, an empty
table gives an empty result, and other columns of the input don't take part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Fixed values: (action, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Terms that block on their own.
STRICT = ("bestiality", "escort", "hentai", "milf", "nude", "nudes", "porn", "porno", "rape", "xvideos", "xxx")
# Terms that block together, with weights.
SOFT = {
    "ads": 1, "adult": 1, "babes": 1, "banner": 1, "bet": 1, "bonus": 1, "cam": 1, "cams": 1, "casino": 1, "cheap": 1, "dating": 1,
    "hot": 1, "jackpot": 1, "kinky": 1, "pills": 1, "poker": 1, "popup": 1, "sex": 1, "sexy": 1, "slots": 1, "track": 1, "tracker": 1,
    "viagra": 1, "warez": 1,
}
#: Summed weight of distinct soft terms that blocks.
SOFT_LIMIT = 2

#: Terms of a vocabulary read from a table.
MOST_TERMS = 1_000_000

RESULT = "host string, path string, rule string, verdict string, n_strict bigint, soft_weight bigint"
_LOWER = {i: i + 32 for i in range(65, 91)}


def _parts(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        return rest.translate(_LOWER), ""
    path = rest[i:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:i].translate(_LOWER), path


def judge(
    url: Column,
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Mapping[str, int] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> Column:
    """struct<host, path, rule, verdict, n_strict, soft_weight> of a URL column.

    A rule fits its host and all subdomains when the path begins with the rule's path; of the
    rules that fit, the longest host and path together wins.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for action, host, path in rules:
        by_host.setdefault(host, []).append((path, action))
    strict, soft = tuple(strict), dict(soft)
    held: list = []

    def automaton():
        if not held:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t in soft:
                a.add_word(t, (len(t), t, False))
            for t in strict:
                a.add_word(t, (len(t), t, True))
            a.make_automaton()
            held.append(a)
        return held[0]

    def rule_of(host: str, path: str):
        best = None
        at = 0
        while host:  # every suffix of the host that begins at a label
            suffix = host[at:]
            for p, action in by_host.get(suffix, ()):
                if path.startswith(p) and (best is None or len(suffix) + len(p) > len(best[0])):
                    best = (suffix + p, action)
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    @F.arrow_udf(RESULT)
    def verdicts(urls: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        for url in urls.to_pylist():
            url = url or ""
            host, path = _parts(url)
            low = url.translate(_LOWER)
            hard, mild = 0, set()
            if strict or soft:
                for end, (n, term, is_strict) in automaton().iter(low):
                    before, after = low[end - n] if end >= n else "", low[end + 1 : end + 2]
                    if _edge(before) and _edge(after):
                        if is_strict:
                            hard += 1
                        else:
                            mild.add(term)
            weight = sum(soft[t] for t in mild)
            rule = rule_of(host, path)
            verdict = rule[1] if rule else "block" if hard or weight >= soft_limit else "allow"
            rows.append((host, path, rule[0] if rule else None, verdict, hard, weight))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "rule", "verdict", "n_strict", "soft_weight"]
        )

    return verdicts(url)


def _edge(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9") if c else True


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> dict[str, object]:
    """The options strict and soft of judge() from rows of term and weight, null for strict terms.

    A-Z in terms is lower-cased, as it is in URLs.  A term with several weights has the greatest; a term that is strict
    in any row is strict only.  Null and empty terms are left out.  The automaton stands in every worker, so a table of more than most terms is refused.
    """
    upper, lower = "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values()))
    low = terms.filter(F.length("term") > 0).select(F.translate("term", upper, lower).alias("term"), "weight")
    rows = low.groupBy("term").agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("strict")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return {"strict": sorted(r["term"] for r in rows if r["strict"]), "soft": {r["term"]: r["weight"] for r in rows if not r["strict"]}}


def url_verdicts(pages: DataFrame, **options) -> DataFrame:
    """One row per page: page_id and the fields of judge().  Reads page_id and url only."""
    prepare(pages.sparkSession)
    return pages.select("page_id", judge(F.col("url"), **options).alias("judged")).select("page_id", "judged.*")


def allowed_pages(pages: DataFrame, **options) -> DataFrame:
    """The rows of pages, all columns unchanged, whose URL is allowed."""
    prepare(pages.sparkSession)
    return pages.filter(judge(F.col("url"), **options)["verdict"] == "allow")


def oracle() -> str:
    """DuckDB SQL for the rows of url_verdicts with the default vocabulary and rules."""
    hit = "regexp_matches(low, '(^|[^a-z0-9])({})($|[^a-z0-9])')"
    hard = hit.format("|".join(STRICT))
    mild = " + ".join(f"CASE WHEN {hit.format(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
    fits = [(h + p, a, f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')") for a, h, p in RULES]
    fits.sort(key=lambda x: -len(x[0]))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{a}'" for _, a, c in fits)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH cut AS (
      SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN {hard} OR ({mild}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
    FROM cut"""
