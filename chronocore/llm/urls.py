"""URL filters: rules by host and path first, then a logistic regression on hashed character n-grams. DataFrame functions only.

The model is trained from a small labelled table of URLs, by full gradient steps over the n-gram counts of those rows;
it is a few thousand weights, a size that no table changes. A page's URL is turned to n-gram buckets, weighted and
judged in one projection, with no shuffle.

Null URLs, and URLs without ``://``, have an empty host and path; no n-gram is left then, and the model's bias decides.
Hosts are lower-cased (A-Z). Rows that repeat get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains, if the path starts with the rule's. The longest wins.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BUCKETS, SIZES = 4096, (3, 4)
STEPS, RATE, DECAY = 200, 0.5, 1e-3
#: Log-odds over which a page is blocked: most pages are wanted ones.
BLOCK_OVER = 0.2

#: Words of unwanted hosts, of ordinary ones, and of either.
UNWANTED = (
    "casino poker slots roulette blackjack jackpot lottery bet bets betting bingo gamble vegas pills pharma viagra cialis tablets steroid porn xxx sex adult erotic escort nude webcam "
    "malware crack warez keygen spam phishing virus trojan loan loans payday forex cash prize winner ads adclick popup tracker track replica fake counterfeit cheap free money"
).split()
ORDINARY = (
    "news daily post library museum garden kitchen city council weather school science forum wiki docs photo travel book history music health sport theatre nation station british bbc guardian times journal "
    "press radio kino house family doctor clinic hospital church charity university college student teacher lesson recipe cooking bakery coffee wine farm forest river mountain ocean island village bridge train "
    "railway airport hotel tourism map guide language grammar poetry novel paint design architect engineer software code data linux physics chemistry biology medicine patient therapy brother sister mother "
    "essex alphabet better address cashmere expert express pillow pillar advice administration freedom slot-car trackside virtue winter"
).split()
EITHER = "online best my the world club shop hub tube now center store win zone live top net web 24 4u x land day".split()
ENDS = ("com", "net", "org", "info", "co.uk", "example.com", "example.net", "example.org")
PATHS = ["/{lang}/{n}", "/{lang}/{n}/", "/{lang}/{n}.html", "/{lang}/{n}?page=2", "/{lang}/{n}#top", "/", ""]


def _syllables(r: random.Random) -> str:
    """A made-up name."""
    starts, ends = "b c d f g h j k l m n p r s t v w z bl ch cl cr dr fl gr pl pr sh sl sp st str th tr wh".split(), ["", "", "l", "m", "n", "r", "s", "t", "ck", "ld", "lt", "nd", "ng", "nt", "rd", "rt", "sh", "st", "th"]
    return "".join(r.choice(starts) + r.choice(["a", "e", "i", "o", "u", "ea", "ou", ""]) + r.choice(ends) for _ in range(r.randint(2, 3)))


def labelled(each: int = 700, seed: int = 1) -> list[tuple[str, int]]:
    """(url, 1 if unwanted), made by rule. Both kinds have the same paths, so that only what sets hosts apart gets weight."""
    r, rows = random.Random(seed), []
    for label in (1, 0):
        for j in range(each):
            words = [r.choice(UNWANTED if label else ORDINARY)] if label or j % 3 else [_syllables(r)]
            if r.random() < 0.7:
                words.insert(r.randrange(2), r.choice(EITHER) if r.random() < 0.6 else r.choice(UNWANTED if label else ORDINARY))
            host = r.choice(["", "", "www.", "m.", "blog."]) + r.choice(["-", "-", ""]).join(words) + "." + r.choice(ENDS)
            rows.append((f"https://{host}" + r.choice(PATHS).format(lang=r.choice(["en", "fr", "de", "es"]), n=r.randrange(1000)), label))
    return rows


def _cut(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def _buckets(text: str) -> list[int]:
    """The bucket of every n-gram: a polynomial of its code points."""
    found = []
    for n in SIZES:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 257 + ord(c)) % 1_000_003
            found.append(h % BUCKETS)
    return found


def train(rows: Sequence[tuple[str, int]] | None = None) -> tuple[float, list[float]]:
    """(bias, weights). The features of a URL are the shares of its n-grams in each bucket, of host and path together."""
    rows = labelled() if rows is None else rows
    features = []
    for url, label in rows:
        found = Counter(_buckets("".join(_framed(*_cut(url)))))
        n = sum(found.values()) or 1
        features.append(([(k, v / n) for k, v in found.items()], label))
    bias, weights = 0.0, [0.0] * BUCKETS
    scale = 40.0  # shares are small; a larger rate makes up for it
    for _ in range(STEPS):
        db, dw = 0.0, {}
        for found, label in features:
            z = bias + sum(weights[k] * v for k, v in found)
            miss = 1 / (1 + math.exp(-z)) - label
            db += miss
            for k, v in found:
                dw[k] = dw.get(k, 0.0) + miss * v
        m = max(len(features), 1)
        bias -= RATE * db / m
        weights = [w * (1 - RATE * DECAY) for w in weights]
        for k, v in dw.items():
            weights[k] -= RATE * scale * scale * v / m
    return round(bias, 6), [round(w, 6) for w in weights]


def _framed(host: str, path: str) -> tuple[str, str]:
    return f"^{host}", f"{path}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def logit(text: Column, bias: float, weights: Sequence[float]) -> Column:
    """The model's log-odds that a page is unwanted."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    table, total, count = F.lit(list(map(float, weights))), F.lit(0.0), F.lit(0)
    # Every array is bound once by aggregate's accumulator, so that no expression is computed again for each n-gram.
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("i"), total.alias("sum"), count.alias("n"))

    def bucket(*xs: Column) -> Column:
        h = F.lit(0).cast("long")
        for x in xs:
            h = (h * 257 + x) % 1_000_003
        return (h % BUCKETS).cast("int")

    def step(s: Column, d: Column) -> Column:
        three, four = s["i"] >= 2, s["i"] >= 3
        gain = F.when(three, F.get(table, bucket(s["b"], s["c"], d))).otherwise(0.0) + F.when(four, F.get(table, bucket(s["a"], s["b"], s["c"], d))).otherwise(0.0)
        return F.struct(s["b"].alias("a"), s["c"].alias("b"), d.alias("c"), (s["i"] + 1).alias("i"), (s["sum"] + gain).alias("sum"), (s["n"] + three.cast("int") + four.cast("int")).alias("n"))

    return F.aggregate(codes, start, step, lambda s: F.lit(float(bias)) + F.when(s["n"] > 0, s["sum"] / s["n"]).otherwise(0.0))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: Sequence[tuple[str, int]] | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    bias, weights = train(labels)
    host, path = host_and_path(pages[url].cast("string"))
    cut = pages.select(pages[key].alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when(logit(F.concat(F.lit("^"), "host", "path", F.lit("$")), bias, weights) > BLOCK_OVER, "block").otherwise("allow")
    return cut.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, model).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_sql() -> str:
    """The same model in SQL: the weights are a literal list."""
    bias, weights = train()
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    said = "\n".join(f"    WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    gram = lambda n: "% 1000003".join([f"{'(' * (n - 1)}c[i]::BIGINT", *[f" * 257 + c[i + {j}])" for j in range(1, n)]]).replace("BIGINT% 1000003", "BIGINT")
    return f"""
WITH w AS (SELECT {[float(x) for x in weights]} AS w),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
f AS (SELECT *, CASE
{fits}
    END AS rule, list_transform(string_split('^' || host || path || '$', ''), lambda x: unicode(x)) AS c FROM u),
g AS (SELECT page_id, host, path, rule,
        list_transform(range(1, len(c) - 1), lambda i: ({gram(3)} % 1000003 % {BUCKETS})::INT) ||
        list_transform(range(1, len(c) - 2), lambda i: ({gram(4)} % 1000003 % {BUCKETS})::INT) AS b FROM f)
SELECT page_id, host, path, rule, CASE rule
{said}
    ELSE CASE WHEN {bias} + coalesce(list_sum(list_transform(b, lambda k: w[k + 1])) / nullif(len(b), 0), 0) > {BLOCK_OVER} THEN 'block' ELSE 'allow' END END AS verdict
FROM g, w
"""
