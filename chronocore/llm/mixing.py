"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

A budget of tokens is split by weight among domains, then languages, then sources. A node can give at most its tokens
times ``EPOCHS``; what it falls short of is shared out by weight among its siblings, and only what all of them together
lack has been taken from their parent's budget beforehand, and went to the parent's siblings. A leaf's budget is spent
on whole epochs first; the rest is a prefix, in tokens, of one more epoch, whose order is a seeded hash of ids and texts.

Budgets are computed on sums by leaf. A leaf's order is cut into ranges of the hash of about ``RANGE_DOCS`` documents:
ranges before the cut are taken whole, and only the range that holds the cut is put in order, so no leaf is ever in one
task. Texts without tokens (null, empty, white space) are never selected. Null languages and sources are nodes of their
own, named ``?``, and nodes without a weight take that of ``*``. Rows that repeat an id, null ids too, are apart in the
order by their texts; rows that repeat both have one place, and where a prefix ends among them so many are taken as fit.
No rows, or no weight, select nothing. Columns ``epoch`` and ``n_tokens`` of the input give way to those of the mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocore.llm import textops
from chronocore.llm.shared import documents, given_id, row_id
from chronocore.plans.storage import hinted, lean, stored

NAMES = ["domain", "lang", "source"]
RANGE_DOCS = 4096
EPOCHS = 4


@dataclass(frozen=True)
class Mix:
    """Integer weights by name (``*``: any other), the share of all tokens to select in percent, and the seed."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"web": 40, "news": 25, "books": 20, "forum": 10, "*": 5})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10, "*": 5})
    sources: Mapping[str, int] = field(default_factory=lambda: {"*": 1})
    #: source -> domain; any other source is its own kind, "other"
    domain_of: Mapping[str, str] = field(default_factory=lambda: {f"src{i}": ("web", "news", "books", "forum")[i // 5] for i in range(20)})
    percent: int = 60
    epochs: int = EPOCHS
    seed: int = 42


def _weight(weights: Mapping[str, int], name: Column) -> Column:
    out = F.lit(weights.get("*", 0))
    for k, w in weights.items():
        if k != "*":
            out = F.when(name == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__tokens``: the number of its tokens, which end at white space."""
    lean(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("__tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = textops.space_bytes()
        for b in batches:
            n = np.zeros(len(b), np.int64)
            for first, part in textops.blocks(pc.fill_null(b.column(at), "")):
                data, offsets = textops.buffers(part)
                inside = kind[data]
                begins = inside.copy()
                if len(data):
                    begins[1:] &= ~inside[:-1]
                    heads = offsets[:-1][np.diff(offsets) > 0]
                    begins[heads] = inside[heads]
                sums = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
                n[first : first + len(part)] = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, "__tokens"])

    return docs.mapInArrow(run, schema)


def leaf(mix: Mix, lang: Column, source: Column) -> dict[str, Column]:
    source = F.coalesce(source.cast("string"), F.lit("?"))
    domain = F.lit("other")
    for s, d in mix.domain_of.items():
        domain = F.when(source == s, F.lit(d)).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(lang.cast("string"), F.lit("?")), "source": source}


def counted(docs: DataFrame, mix: Mix, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(id, content, domain, lang, source, n_tokens) of every row that has a token, stored."""
    rows = docs.select(row_id(docs, key), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].cast("string").alias("text"))
    names = leaf(mix, F.col("lang"), F.col("source"))
    return stored(with_tokens(rows).filter("__tokens > 0").select("id", _content(F.col("text")), *[c.alias(n) for n, c in names.items()], F.col("__tokens").alias("n_tokens")))


def _content(text: Column) -> Column:
    return F.md5(text.cast("binary")).alias("content")


def filled(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """``nodes`` (parent, child, weight, room, budget of the parent) with ``given``: shares by weight, none over its room.

    Siblings fill up to a common level of room over weight; those that are full leave what they lack to the others.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy("ratio", child)
    n = nodes.filter("weight > 0").withColumn("ratio", F.col("room") / F.col("weight"))
    n = n.withColumns({
        "before": F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    n = n.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(of))
    given = F.when(F.col("level").isNull(), F.col("room").cast("double")).otherwise(F.least(F.col("room").cast("double"), F.col("level") * F.col("weight")))
    return n.withColumn("given", given).drop("ratio", "before", "left", "level")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, docs, given) from (domain, lang, source, tokens, docs)."""
    names = ["domain", "lang", "source"]
    leaves = leaves.withColumns({f"w_{c}": _weight(w, F.col(c)) for c, w in zip(names, (mix.domains, mix.langs, mix.sources), strict=True)})
    leaves = leaves.filter("w_domain > 0 and w_lang > 0 and w_source > 0").withColumn("room", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * mix.percent / 100).cast("double").alias("budget"))
    above = total
    for depth, child in enumerate(names):
        parent, level = names[:depth], names[: depth + 1]
        nodes = leaves.groupBy(*level).agg(F.first(f"w_{child}").alias("weight"), F.sum("room").alias("room"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row
        above = filled(nodes, parent, child).select(*level, F.col("given").alias("budget"))
    return leaves.select(*names, "tokens", "docs").join(above, names).withColumnRenamed("budget", "given")


def order_key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(mix.seed)), epoch.cast("string"), given_id().cast("string"), F.col("content")).cast("binary"))


def _range(ranges: Column) -> Column:
    """The first 32 bits of the order, scaled to the number of ranges of the leaf."""
    return F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges, 32)


def cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """Where each leaf is cut, stored: (domain, lang, source, whole, rest, ranges, cut, last, copies).

    ``whole`` epochs are taken; of one more, all ranges before ``cut`` (null: all), of that range what comes before
    ``last`` in the order, and of the equal rows at ``last`` so many ``copies``. ``rows`` is from counted().
    """
    leaves = stored(rows.groupBy(*NAMES).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    plan = budgets(leaves, mix).withColumn("whole", F.floor(F.col("given") / F.col("tokens")).cast("long"))
    plan = plan.withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens"))
    plan = stored(plan.withColumn("ranges", F.ceil(F.col("docs") / RANGE_DOCS).cast("long")).select(*NAMES, "whole", "rest", "ranges"))
    part = rows.join(hinted(plan.filter("rest > 0")), NAMES).withColumn("order", order_key(mix, F.col("whole"))).withColumn("range", _range(F.col("ranges")))
    sums = part.groupBy(*NAMES, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    end = F.sum("tokens").over(Window.partitionBy(*NAMES).orderBy("range"))
    over = sums.withColumn("end", end).filter("end > rest").groupBy(*NAMES).agg(F.min(F.struct("range", (F.col("end") - F.col("tokens")).alias("start"))).alias("at"))
    over = stored(over.select(*NAMES, F.col("at.range").alias("cut"), "at.start"))
    # Equal rows are one line here, however many they are.
    inner = part.join(hinted(over), NAMES).filter("range = cut").groupBy(*NAMES, "order", "rest", "start", "n_tokens").agg(F.sum("n_tokens").alias("tokens"))
    to = F.sum("tokens").over(Window.partitionBy(*NAMES).orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("to", F.col("start") + to).filter("to > rest")
    copies = F.floor((F.col("rest") - F.col("to") + F.col("tokens")) / F.col("n_tokens")).cast("long")
    last = inner.groupBy(*NAMES).agg(F.min(F.struct("order", copies.alias("copies"))).alias("last"))
    last = last.select(*NAMES, F.col("last.order").alias("last"), "last.copies")
    return stored(plan.join(over.drop("start"), NAMES, "left").join(last, NAMES, "left"))


def selected(rows: DataFrame, where: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (id, content, domain, lang, source, n_tokens, ...) with ``epoch``, once for each epoch that takes them; nothing is shuffled by row."""
    names = rows.columns
    rows = rows.join(hinted(where), NAMES).withColumn("order", order_key(mix, F.col("whole"))).withColumn("range", _range(F.col("ranges")))
    inside = F.col("cut").isNull() | (F.col("range") < F.col("cut")) | ((F.col("range") == F.col("cut")) & (F.col("order") < F.col("last")))
    rows = rows.withColumn("more", ((F.col("rest") > 0) & inside).cast("long"))
    if not where.filter("copies > 0").isEmpty():
        at = F.coalesce((F.col("order") == F.col("last")) & (F.col("copies") > 0), F.lit(False))
        rows = rows.filter(~at).unionByName(_first_copies(rows.filter(at)))
    rows = rows.withColumn("times", F.col("whole") + F.col("more")).filter("times > 0")
    return rows.select(*[n for n in names if n != "content"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))


def _first_copies(rows: DataFrame) -> DataFrame:
    """Equal rows at the cuts, ``copies`` of each leaf with ``more``. They are numbered part by part, as they lie, so no leaf's are in one task."""
    names = rows.columns
    held = stored(rows.withColumn("uid", F.monotonically_increasing_id())).withColumn("part", F.shiftright("uid", 33))
    sizes = held.groupBy(*NAMES, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*NAMES).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stored(sizes.select(*NAMES, "part", F.coalesce(before, F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy(*NAMES, "part").orderBy("uid")) + F.col("before")
    return held.join(hinted(sizes), [*NAMES, "part"]).withColumn("more", (place <= F.col("copies")).cast("long")).select(names)


def mixed(docs: DataFrame, mix: Mix, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are selected, once for each epoch, with ``epoch`` and ``n_tokens``; texts stay where they are."""
    where = cuts(counted(docs, mix, text, lang, source, key), mix)
    kept = [docs[c] for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    value = docs[text].cast("string")
    packed = docs.select(row_id(docs, key), value.alias("text"), docs[lang].alias("lang"), docs[source].alias("source"), F.struct(*kept).alias("row"))
    names = leaf(mix, F.col("lang"), F.col("source"))
    rows = with_tokens(packed).filter("__tokens > 0").select("id", "row", _content(F.col("text")), *[c.alias(n) for n, c in names.items()], F.col("__tokens").alias("n_tokens"))
    return selected(rows, where, mix).select("row.*", "epoch", "n_tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    rows = counted(documents(spark, sf_dir), mix)
    found = selected(rows, cuts(rows, mix), mix)
    return found.select(given_id().alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


def op3_sql(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    weight = lambda w, c: "CASE" + "".join(f" WHEN {c} = '{k}' THEN {v}" for k, v in w.items() if k != "*") + f" WHEN true THEN {w.get('*', 0)} END"
    domain = "CASE source" + "".join(f" WHEN '{s}' THEN '{d}'" for s, d in mix.domain_of.items()) + " ELSE 'other' END"
    names, above, parts = ["domain", "lang", "source"], "total", []
    for depth, child in enumerate(names):
        parent, level = ", ".join(names[:depth]) or "0", ", ".join(names[: depth + 1])
        join = f"JOIN {above} USING ({parent})" if depth else f"CROSS JOIN {above}"
        parts.append(f"""
n{depth} AS (SELECT {level}, any_value(w_{child}) AS weight, sum(room) AS room FROM leaves GROUP BY ALL),
r{depth} AS (SELECT {level}, weight, room, budget, room / weight AS ratio FROM n{depth} {join}),
s{depth} AS (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{depth}),
t{depth} AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER (PARTITION BY {parent}) AS top FROM s{depth}),
b{depth} AS (SELECT {level}, CASE WHEN top IS NULL THEN room::DOUBLE ELSE least(room::DOUBLE, top * weight) END AS budget FROM t{depth}),""")
        above = f"b{depth}"
    return rf"""
WITH raw AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, md5(text) AS content,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT *, {domain} AS domain FROM raw WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {mix.epochs} AS room,
    {weight(mix.domains, "domain")} AS w_domain, {weight(mix.langs, "lang")} AS w_lang, {weight(mix.sources, "source")} AS w_source FROM d GROUP BY domain, lang, source),
total AS (SELECT floor(sum(tokens) * {mix.percent} / 100)::DOUBLE AS budget FROM leaves),{"".join(parts)}
p AS (SELECT d.*, floor(budget / tokens)::BIGINT AS whole, budget - floor(budget / tokens)::BIGINT * tokens AS rest FROM d JOIN leaves USING (domain, lang, source) JOIN b2 USING (domain, lang, source)),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('/', '{mix.seed}', whole, doc_id, content)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM p)
SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch FROM q WHERE so_far <= rest
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM p WHERE whole > 0
"""
