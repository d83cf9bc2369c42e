"""Exact duplicates and repeated lines, against plain versions."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from chronocore.llm import exact, fuse, lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line is certainly longer than forty characters É"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n long")


ROWS = [(1, "Same Text"), (2, "same text"), (3, "same texT"), (4, "SAME É"), (5, "same é"), (6, None), (7, ""), (8, "a" * 300_000), (9, "A" * 300_000), (10, "alone"), (None, "alone"), (None, "none"), (None, "none"), (11, "twice"), (11, "twice"), (11, "other")]


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [ids.index(keep) == j for j in range(len(ids))]
        out += [(i, keep, len(ids), k, sha256(t.encode()).hexdigest()) for i, k in zip(ids, kept, strict=True)]
    return sorted(map(str, out))


def test_exact_against_plain(spark):
    assert sorted(str(tuple(r)) for r in exact.duplicates(docs(spark, ROWS)).collect()) == plain_exact(ROWS)
    assert exact.duplicates(docs(spark, ROWS).limit(0)).count() == 0


def test_colliding_digests_are_split_by_bytes(spark):
    weak = lambda text: bytes([len(text) % 2] * 32)
    found = exact.duplicates(docs(spark, ROWS), digest=weak).drop("digest")
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(r.rsplit(", ", 1)[0] + ")" for r in plain_exact(ROWS))


def test_keep_one(spark):
    found = exact.keep_one(docs(spark, ROWS))
    assert found.columns == ["doc_id", "text", "id", "n"]
    truth = {(max((i for i, u in ROWS if (u or "").translate(LOWER) == k and i is not None), default=None), k) for k in {(t or "").translate(LOWER) for _, t in ROWS}}
    assert sorted(map(str, {(r.doc_id, (r.text or "").translate(LOWER)) for r in found.collect()})) == sorted(map(str, truth)) and found.count() == len(truth)
    plain = [r for r in ROWS if r[0] not in (None, 11)]
    assert sorted(r.doc_id for r in exact.keep_one(docs(spark, plain)).collect()) == [3, 4, 5, 7, 9, 10]


def test_names_that_clash_and_a_stored_snapshot(spark, tmp_path):
    rows = [(1, "a", "keep", "mine", 5), (2, "A", "x", "y", 6), (2, "A", "x", "z", 7), (3, "b", "p", "q", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __id string, digest string, gone int")
    found = sorted(tuple(r) for r in exact.keep_one(table).collect())
    assert len(found) == 2 and found[0] in rows[1:3] and found[1] == rows[3]
    assert sorted(tuple(r) for r in exact.keep_one(table.filter("gone <> 7")).collect()) == [rows[1], rows[3]]
    digested = exact.digests(docs(spark, ROWS))
    exact.save(exact.freeze(digested), str(tmp_path / "snapshot"))
    again = exact.load(spark, str(tmp_path / "snapshot"))
    batch = exact.digests(docs(spark, [(50, "SAME TEXT"), (51, "new"), (52, "new"), (53, "news")]))
    screened = exact.screen(again, batch)
    assert {bytes(r.digest): r.n for r in screened.filter("not positive").collect()} == {sha256(b"new").digest(): 2, sha256(b"news").digest(): 1}
    found = {bytes(r.digest): (r.keep.id, r.n) for r in exact.merged(again, screened).collect()}
    assert found[sha256(b"same text").digest()] == (50, 4) and found[sha256(b"new").digest()] == (52, 2) and sha256(b"news").digest() not in found


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 50_000])
def test_binary_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    data = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(data, keys).all()
    assert fuse.contains(data, np.arange(100_000, dtype=np.uint64)).mean() < 1e-3


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    ident = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(ident(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        left = [x for x in all_lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != ident(i))]
        out.append((i, len(all_lines), len(all_lines) - len(left), sha256("\n".join(left).encode()).hexdigest()))
    return sorted(map(str, out))


def test_lines_against_plain(spark, tmp_path):
    rows = [(i, f"own line {i}\n {LONG.upper() if i % 2 else LONG}\t\n\nshort\n{LONG}") for i in range(6)]
    rows += [(10, LONG.lower()), (11, None), (12, ""), (13, "\n\n"), (14, "x\r\n" + "\u00a0" + LONG), (None, LONG), (3, "another text of 3\n" + LONG), (5, rows[5][1]), (20, "y" * 39), (21, ("z" * 50 + "\n") * 5000)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = lines.op2_line_dedup(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_lines(rows)
    assert lines.without_repeated_lines(docs(spark, rows).limit(0)).count() == 0
    kept = {r.id: r.text for r in lines.without_repeated_lines(docs(spark, rows)).collect()}
    assert kept[10].startswith("this line") and kept[0] == "own line 0\n\nshort"
