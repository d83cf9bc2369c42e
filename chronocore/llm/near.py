"""Near duplicates: Order MinHash proposes, banded alignment decides.

A text's k-mers are its windows of five words, labelled by occurrence. Each of ``FUNCTIONS`` hash functions samples the
``MINIMA`` least k-mers, and every two of them, in the order of the text, make a key; texts with a common key of a
function are candidates, and the order makes the keys follow edit similarity rather than the overlap of sets. Two texts
are linked if the edit distance of their words (lower-cased runs of letters and digits) is at most a fifth of the longer
one. The result is one row per document with its class, the connected component of the links.

Copies (equal words) are made one first. Texts of a key that few share are compared with each other. A larger group
is compared with its least member; what that does not link goes on to groups that share one key more, of the next
function. With ``BLOCK_DEPTH`` keys in common, groups that a task can hold are compared there; larger ones go
on as before, and at ``DEPTH`` keys they are worked off by their ``LEADERS`` least members at a time. So no row is made
for each pair of a group, and no text is dropped.

Texts without words are classed by their exact text; null texts are empty. Texts of fewer than five words have one
k-mer. Rows with a null id are documents of their own, and the least id of a class names it; rows that repeat an id
are each classed by their own text, so such an id may be in two classes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocore.llm import textops
from chronocore.llm.align import alike
from chronocore.llm.shared import NULL_ID, documents, fresh, given_id, row_id
from chronocore.operators.components import connected_components
from chronocore.plans.storage import forget, hinted, stored, sweep

WORDS, SIMILARITY = 5, 0.8
#: Hash functions, and minima of each. With a k-mer overlap (Jaccard) of a fifth, as of texts with a fifth of their words edited, two texts share a key with a chance of 0.96.
FUNCTIONS, MINIMA = 10, 4
PAIRS = MINIMA * (MINIMA - 1) // 2
#: Groups up to this size are compared pair by pair at once; larger ones go on to groups of one key more, of the NEXT first ones of a function.
FEW, NEXT = 8, 2
#: From this depth on, groups of at most BLOCK texts and BLOCK_WORDS words are compared in a task each; others go on.
BLOCK_DEPTH, BLOCK, BLOCK_WORDS = 3, 512, 1 << 22
#: At this depth keys are used up: the least LEADERS members of a group are compared with all others, and then the next.
DEPTH, LEADERS = 8, 64
#: Counters of a text's words by hash; the sum of the lesser ones is no less than the number of words in common.
COUNTERS = 128
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _multipliers(n: int) -> np.ndarray:
    return textops.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, n) | np.uint64(1)


def labelled(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """k-mer hashes, each with the number of times it came before in its text."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    within = textops.mix(hashes ^ textops.mix(owner + np.uint64(1)))
    order = np.argsort(within, kind="stable")
    run = within[order]
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    if new.all():
        return textops.mix(hashes)
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    times = np.empty(len(run), np.uint64)
    times[order] = (np.arange(len(run)) - first).astype(np.uint64)
    return textops.mix(hashes + times * np.uint64(0xD6E8FEB86659FD93))


def order_minhash(hashes: np.ndarray, starts: np.ndarray, functions: int = FUNCTIONS, minima: int = MINIMA) -> np.ndarray:
    """Keys, texts x (functions x pairs): for each function the ``minima`` least labelled k-mers, each two of them joined in the order of the text.

    ``starts`` must leave no text empty. The low bits of a labelled hash give way to its place, so that a minimum tells
    where it is. Where a text has fewer k-mers, the least one stands for the rest.
    """
    # Ranks of the minima, the least ones first: the first n (n - 1) / 2 keys are those of the n least.
    first, right = starts[:-1], np.repeat(np.arange(1, minima), np.arange(1, minima))
    left = np.concatenate([np.arange(j) for j in range(1, minima)])
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    mask, place = (np.uint64(1) << bits) - np.uint64(1), np.arange(len(hashes), dtype=np.uint64)
    marked, (times, plus) = labelled(hashes, starts), _multipliers(functions)
    keys = np.empty((len(first), functions, len(left)), np.uint64)
    for i in range(functions):
        h = marked * times[i]
        h = ((h ^ (h >> np.uint64(32))) * plus[i] >> bits << bits) | place
        found = np.empty((len(first), minima), np.int64)
        for j in range(minima):
            least = np.minimum.reduceat(h, first)
            there = least != _MAX
            found[:, j] = np.where(there, least & mask, found[:, 0])
            h[found[:, j]] = _MAX
        lead, tail = np.minimum(found[:, left], found[:, right]), np.maximum(found[:, left], found[:, right])
        keys[:, i] = textops.mix(hashes[lead] * np.uint64(0x9E3779B97F4A7C15) + hashes[tail])
    return keys.reshape(len(first), -1)


def _words(part: pa.Array, values: np.ndarray) -> textops.Tokens:
    return textops.tokens(pc.utf8_lower(part), textops.word_bytes(), values)


def _content(words: np.ndarray, text: str) -> bytes:
    """128 bits for the words of a text, or for the text itself if it has none."""
    return xxhash.xxh3_128_digest(words.tobytes()) if len(words) else xxhash.xxh3_128_digest(text.encode(), seed=1)


def sketched(docs: DataFrame, functions: int = FUNCTIONS, minima: int = MINIMA, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, content, n_words, keys) of every row, stored; keys is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = textops.byte_values()
        for b in batches:
            for first, part in textops.blocks(b.column(1)):
                t = _words(part, values)
                grams, starts = textops.ngrams(t, WORDS)
                full = np.flatnonzero(np.diff(starts))
                found = order_minhash(grams, np.append(starts[full], starts[-1]), functions, minima) if len(full) else None
                keys: list[np.ndarray | None] = [None] * len(part)
                for j, i in enumerate(full):
                    keys[i] = found[j].view(np.int64)
                content = [_content(t.hashes[t.starts[i] : t.starts[i + 1]], part[i].as_py() if keys[i] is None else "") for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(content, pa.binary()), pa.array(np.diff(t.starts)), pa.array(keys, pa.list_(pa.int64()))], ["id", "content", "n_words", "keys"])

    rows = docs.select(row_id(docs, key), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "id long, content binary, n_words long, keys array<long>"))


def word_lists(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, content, words) of every row; words are 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = textops.byte_values()
        for b in batches:
            for first, part in textops.blocks(b.column(1)):
                t = _words(part, values)
                short = (t.hashes >> np.uint64(32)).astype(np.uint32)
                spans = list(zip(t.starts[:-1], t.starts[1:], strict=True))
                words = [short[x:y].tobytes() for x, y in spans]
                content = [_content(t.hashes[x:y], part[i].as_py() if x == y else "") for i, (x, y) in enumerate(spans)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(content, pa.binary()), pa.array(words, pa.binary())], ["id", "content", "words"])

    rows = docs.select(row_id(docs, key), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, content binary, words binary")


def verified(edges: DataFrame, lists: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``edges`` (a, b) with ``linked``: whether the alignment of the two contents is close enough. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            good = [alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), similarity) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    # Members come first: a leader has many edges, and is the side that AQE splits.
    pairs = edges.join(lists.select(F.col("content").alias("b"), F.col("words").alias("wb")), "b").join(lists.select(F.col("content").alias("a"), F.col("words").alias("wa")), "a")
    return stored(pairs.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary, linked boolean"))


def _groups(members: DataFrame) -> DataFrame:
    """Members (bucket, band, node) of groups of two at least, with leader and size."""
    # Members are shuffled once; a window spills, so a large group needs no room for all of its rows.
    own = Window.partitionBy("bucket")
    return stored(members.withColumns({"leader": F.min("node").over(own), "n": F.count("*").over(own)}).filter("n > 1"))


def _few(groups: DataFrame, most: int) -> DataFrame:
    """All pairs (a < b) of groups of ``most`` members at most."""
    few = groups.filter(F.col("n") <= most).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.lit(most)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _stars(groups: DataFrame, most: int, leaders: int) -> DataFrame:
    """(bucket, leader, node) of larger groups: every other member with the least ones of its group, ``leaders`` of them."""
    large = groups.filter(F.col("n") > most)
    if leaders == 1:
        return large.filter(F.col("node") != F.col("leader")).select("bucket", "leader", "node")
    first = large.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("node"))).filter(F.col("rank") <= leaders)
    return large.drop("leader").join(first.select("bucket", F.col("node").alias("leader")), "bucket").filter("leader < node").select("bucket", "leader", "node")


def compared(members: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within small groups (bucket, node), each compared in one task; a link that joins nothing new is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        texts = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
        bags = [np.unique(x, return_counts=True) for x in texts]
        part, found = list(range(len(texts))), []
        for j in range(len(texts)):
            for i in range(j):
                longest, shortest = max(len(texts[i]), len(texts[j])), min(len(texts[i]), len(texts[j]))
                if part[i] == part[j] or shortest < similarity * longest - 1e-9:
                    continue
                _, x, y = np.intersect1d(bags[i][0], bags[j][0], assume_unique=True, return_indices=True)
                if np.minimum(bags[i][1][x], bags[j][1][y]).sum() >= similarity * longest - 1e-9 and alike(texts[i], texts[j], similarity):
                    found.append((pdf["node"][i], pdf["node"][j]))
                    old = part[j]
                    part = [part[i] if p == old else p for p in part]
        return pd.DataFrame(found, columns=["a", "b"])

    rows = members.select("bucket", "node").join(words.select(F.col("content").alias("node"), "words"), "node")
    # Few rows with much work each: as many partitions as a shuffle has, not joined by their bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").groupBy("bucket").applyInPandas(run, "a binary, b binary")


def _counters(texts: list[np.ndarray]) -> np.ndarray:
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    kind = np.concatenate([*texts, np.zeros(0, np.uint32)]) % COUNTERS
    return np.bincount(owner * COUNTERS + kind, minlength=len(texts) * COUNTERS).reshape(-1, COUNTERS).astype(np.int32)


def between(first: pd.DataFrame, second: pd.DataFrame | None, similarity: float, bucket: int | None = None) -> list[tuple[bytes, bytes]]:
    """Links that join components among the rows (node, component, words) of ``first``, or between those of both.

    With a ``bucket``, rows have the groups of each text that are compared now (``also``) and those that were (``before``):
    two texts are aligned in the least group that they share, and not again if they shared one before.
    """
    whole = first if second is None else pd.concat([first, second], ignore_index=True)
    also, before = ([frozenset(() if x is None else x) for x in whole[c]] if bucket is not None else [] for c in ("also", "before"))
    nodes = whole["node"].tolist()
    part = pd.factorize(whole["component"])[0]
    texts = [np.frombuffer(x, np.uint32) for x in whole["words"]]
    length, counters = np.array([len(x) for x in texts]), _counters(texts)
    found = []
    for j in range(1 if second is None else len(first), len(nodes)):
        to = j if second is None else len(first)
        least = similarity * np.maximum(length[:to], length[j]) - 1e-9
        near = np.flatnonzero((part[:to] != part[j]) & (np.minimum(length[:to], length[j]) >= least))
        near = near[np.minimum(counters[near], counters[j]).sum(axis=1) >= least[near]]
        for i in near.tolist():
            if part[i] == part[j] or bucket is not None and (min(also[i] & also[j]) != bucket or before[i] & before[j]):
                continue
            if alike(texts[i], texts[j], similarity):
                found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                part[part == part[j]] = part[i]
    return found


def rest(members: DataFrame, found: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join components of ``found`` and lie within a group of ``members`` (bucket, node).

    Every two members are compared unless they are in one component by then; groups of the same members are one. The
    largest group of each component goes first, as it joins most of what the other groups would align again.
    """
    parts = connected_components(found)
    # Hashes of components are enough to tell them apart; members of open groups are shuffled after that.
    label = F.xxhash64(F.coalesce("component", "node"))
    # A text's groups, one for each of its keys at most, are one row until its component is joined to it.
    sized = words.select(F.col("content").alias("node"), (F.length("words") / 4).cast("long").alias("n_words")).join(parts, "node", "left")
    sized = stored(sized.select("node", "n_words", label.alias("component")))
    own = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    named = stored(own.join(sized, "node").select("node", "n_words", "component", F.explode("buckets").alias("bucket")))
    named = stored(named.join(hinted(stored(_open(named))), "bucket", "left_semi"))
    group = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in range(2)]
    size = named.groupBy("bucket").agg(*group, F.count("*").alias("n"), F.sum("n_words").alias("n_words"))
    size = size.groupBy("same0", "same1", "n").agg(F.min("bucket").alias("bucket"), F.first("n_words").alias("n_words"))
    size = size.select("bucket", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    named = stored(named.drop("n_words").join(size, "bucket"))
    some = hinted(stored(named.groupBy("component").agg(F.max(F.struct("n", "bucket")).alias("most")).select("most.bucket").distinct()))
    largest = stored(named.join(some, "bucket", "left_semi"))
    one = _compared_in_full(largest, words, similarity)
    left = named.join(some, "bucket", "left_anti")
    if not one.isEmpty():
        label = named.select("node", "component").distinct()
        ends = one.join(label.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        joined = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
        left = left.join(joined, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    left = stored(left)
    return one.unionByName(_compared_in_full(left.join(_open(left), "bucket", "left_semi"), words, similarity, largest))


def _open(named: DataFrame) -> DataFrame:
    """(bucket) of groups in more than one component."""
    return named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")


def _compared_in_full(named: DataFrame, words: DataFrame, similarity: float, before: DataFrame | None = None) -> DataFrame:
    """Links of groups (bucket, node, component, blocks) that those of ``before`` leave: a task for every two blocks of a group. Stored."""
    # A text's groups are one row until its words are joined to it.
    own = named.groupBy("node").agg(F.collect_list(F.struct("bucket", "component", "blocks")).alias("all"))
    was = F.lit(None).cast("array<long>").alias("before") if before is None else F.col("before")
    own = own if before is None else own.join(before.groupBy("node").agg(F.collect_list("bucket").alias("before")), "node", "left")
    own = own.join(words.select(F.col("content").alias("node"), "words"), "node")
    rows = own.select("node", "words", F.col("all.bucket").alias("also"), was, F.explode("all").alias("g")).select("node", "words", "also", "before", "g.*")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "words", "also", "before")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        one, two = (pdf[pdf["block"] == i].reset_index(drop=True) for i in key[1:])
        return pd.DataFrame(between(one, None if key[1] == key[2] else two, similarity, key[0]), columns=["a", "b"])

    # Few rows with much work each: as many partitions as a shuffle has, not joined by their bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(run, "a binary, b binary"))


def _keys(pairs: int, band: Column, most: int) -> Column:
    """The first keys of a function."""
    return F.array_distinct(F.slice("keys", band * pairs + 1, min(pairs, most)))


def links(nodes: DataFrame, lists: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between contents, each verified.

    ``nodes`` is stored: (content, n_words, keys), with ``pairs`` keys for each function; ``lists`` stores the words of
    given contents, once.
    """
    functions = (F.size("keys") / pairs).cast("int")
    members = nodes.filter("keys is not null").select(F.posexplode(F.transform(F.sequence(F.lit(0), functions - 1), lambda i: _keys(pairs, i, pairs))).alias("band", "own"), F.col("content").alias("node"))
    members = members.select("band", F.explode("own").alias("key"), "node").select(F.xxhash64("band", "key").alias("bucket"), "band", "node")
    known = words = within = first = None
    for depth in count(1):
        if depth >= BLOCK_DEPTH:
            size = stored(members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).filter("n > 1"))
            fits = (F.col("n") <= BLOCK) & (F.col("words") <= BLOCK_WORDS)
            here = stored(compared(members.join(size.filter(fits), "bucket", "left_semi"), words, similarity))
            within = here if within is None else within.unionByName(here)
            if size.filter(~fits).isEmpty():
                break
            members = members.join(size.filter(~fits), "bucket", "left_semi")
        groups = _groups(members)
        if depth == 1:  # the shuffle of all keys is the largest one
            sweep(groups.sparkSession)
        words = lists(groups.select(F.col("node").alias("content")).distinct()) if words is None else words
        first = groups.filter(F.col("n") > FEW).select("bucket", "node") if first is None else first
        stars = _stars(groups, FEW, 1 if depth < DEPTH else LEADERS)
        edges = _few(groups, FEW).unionByName(stars.select(F.col("leader").alias("a"), F.col("node").alias("b"))).distinct()
        edges = edges.join(known, ["a", "b"], "left_anti") if known is not None else edges
        found = verified(edges, words, similarity)
        sweep(found.sparkSession)  # the words of pairs
        known = found if known is None else known.unionByName(found)
        # Members of larger groups that no leader links, leaders aside.
        linked = stars.join(known.filter("linked").select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_semi")
        done = linked.select("bucket", "node").unionByName(stars.select("bucket", F.col("leader").alias("node"))).distinct()
        left = stored(groups.filter(F.col("n") > FEW).join(done, ["bucket", "node"], "left_anti").drop("leader", "n"))
        if left.isEmpty():
            break
        if depth >= DEPTH:
            members = left
            continue
        # One key more, of the function after the last.
        more = left.select("bucket", "band", "node").join(nodes.select(F.col("content").alias("node"), "n_words", "keys"), "node").withColumn("band", (F.col("band") + 1) % functions)
        more = more.select("bucket", "band", "node", "n_words", F.explode(_keys(pairs, F.col("band"), NEXT)).alias("key"))
        members = stored(more.select(F.xxhash64("bucket", "band", "key").alias("bucket"), "band", "node", "n_words").distinct())
    found = known.filter("linked").select("a", "b")
    found = stored(found if within is None else found.unionByName(within))
    sweep(found.sparkSession)
    return found.unionByName(rest(first, found, words, similarity))


def classes(docs: DataFrame, similarity: float = SIMILARITY, functions: int = FUNCTIONS, minima: int = MINIMA, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, content, class_id, class_size) of every row of ``docs``."""
    rows = sketched(docs, functions, minima, text, key)
    sketches, rows = rows, stored(rows.select("id", "content"))
    nodes = stored(sketches.groupBy("content").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    forget(sketches)

    def lists(ends: DataFrame) -> DataFrame:
        wanted = hinted(stored(nodes.join(ends, "content").select("id", "content")))
        found = word_lists(docs, text, key).join(wanted, ["id", "content"], "left_semi")
        return stored(found.dropDuplicates(["content"]).select("content", "words"))

    found = stored(links(nodes, lists, similarity, minima * (minima - 1) // 2))
    parts = connected_components(found).select(F.col("node").alias("content"), "component")
    whole = nodes.select("id", "content", "n").join(parts, "content", "left").withColumn("component", F.coalesce("component", "content"))
    size = whole.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    named = stored(whole.join(size, "component").select("content", "class_id", "class_size"))
    return rows.join(named, "content")


def _with_content(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with ``name``: the content as in classes()."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = textops.byte_values()
        for b in batches:
            for first, part in textops.blocks(b.column(len(names))):
                t = _words(part, values)
                content = [_content(t.hashes[x:y], part[i].as_py() if x == y else "") for i, (x, y) in enumerate(zip(t.starts[:-1], t.starts[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(part)) for c in b.columns[:-1]), pa.array(content, pa.binary())], [*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    return docs.withColumn(name, F.coalesce(docs[text].cast("string"), F.lit(""))).mapInArrow(run, schema)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: the one with the least id. A null id stands for itself.

    Rows that repeat an id are judged each by its own text; of several texts under the id that names a class one stays.
    Rows that repeat both the id and the words are one document.
    """
    found = stored(classes(docs, similarity, text=text, key=key))
    first = found.filter("id = class_id").groupBy("class_id").agg(F.min("content").alias("first"))
    judged = found.join(first, "class_id").filter(F.col("id") != F.lit(NULL_ID))
    of, own, gone_ = fresh(docs, "of"), fresh(docs, "own"), fresh(docs, "gone")
    judged = judged.select(F.col("id").alias(of), F.col("content").alias(gone_), ((F.col("id") == F.col("class_id")) & (F.col("content") == F.col("first"))).alias("stays"))
    judged = stored(judged)
    whole = judged.groupBy(of).agg(F.max("stays").alias("some"), F.min("stays").alias("every")).filter("not every")
    whole = stored(whole.select(of, "some"))
    left = docs.join(hinted(stored(whole.filter("not some").select(of))), docs[key].cast("long") == F.col(of), "left_anti")
    part = stored(whole.filter("some").select(of))
    if part.isEmpty():
        return left
    gone = stored(judged.filter("not stays").join(part, of, "left_semi").select(of, gone_).distinct())
    mixed = _with_content(left.join(hinted(part), left[key].cast("long") == F.col(of), "left_semi"), text, own)
    mixed = mixed.join(gone, (mixed[key].cast("long") == F.col(of)) & (F.col(own) == F.col(gone_)), "left_anti")
    return left.join(hinted(part), left[key].cast("long") == F.col(of), "left_anti").unionByName(mixed.drop(own))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select(given_id().alias("doc_id"), given_id("class_id").alias("class_id"), "class_size")
