"""Near duplicates, passages, test items and the mix: plain versions on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from chronocore.llm import decontam, mixing, near, passages, textops
from chronocore.llm.align import alike, distance_within

R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(3000)]


def text(n, r=R):
    return " ".join(r.choices(VOCABULARY, k=n))


def edited(t, share, r=R):
    words = t.split()
    for _ in range(int(len(words) * share)):
        i, what = r.randrange(len(words)), r.random()
        if what < 0.5:
            words[i] = r.choice(VOCABULARY)
        elif what < 0.75:
            words.insert(i, r.choice(VOCABULARY))
        elif len(words) > 1:
            words.pop(i)
    return " ".join(words)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n long")


def test_banded_distance():
    r = random.Random(2)
    for _ in range(4000):
        a = [r.randrange(4) for _ in range(r.randint(0, 14))]
        b = [r.randrange(4) for _ in range(r.randint(0, 14))] if r.random() < 0.5 else [x for x in a if r.random() < 0.9]
        limit, d = r.randint(0, 8), plain_distance(a, b)
        assert distance_within(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (d if d <= limit else None)
    assert alike(np.zeros(0, np.uint32), np.zeros(0, np.uint32), 0.8)


def parts_of(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = defaultdict(set)
    for x in nodes:
        out[root(x)].add(x)
    return sorted(map(sorted, out.values()))


def test_near_duplicates_against_all_pairs(spark):
    base = [text(R.randint(8, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i % 20], 0.08)) for i in range(60)]
    rows += [(300 + i, edited(base[0] + " " + text(150), 0.04) if i % 2 else base[1].upper() + "!") for i in range(30)]
    passage = text(60)
    rows += [(500 + i, f"{text(20)} {passage} {text(20)}") for i in range(40)]
    words = {i: np.array([hash(w) & 0xFFFFFFFF for w in t.lower().replace("!", "").split()], np.uint32) for i, t in rows}
    links = [(a, b) for a in words for b in words if a < b and alike(words[a], words[b], 0.8)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "..."), (904, "one"), (905, "One!"), (906, "word " * 20_000), (None, text(50)), (7, base[7])]
    found = near.classes(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    got = defaultdict(set)
    for r in found:
        if 0 <= r.id < 900:
            got[r.class_id].add(r.id)
    assert sorted(map(sorted, got.values())) == parts_of(links, words)
    named = {r.id: r.class_id for r in found}
    assert (named[901], named[903], named[905], named[906]) == (900, 902, 904, 906)
    kept = near.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "n"]
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(r.id for r in found if r.id == r.class_id and r.id >= 0)
    assert near.classes(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [40, 100, 300])
def test_recall_of_keys_by_share_of_edits(n):
    r = random.Random(n)
    for share, least in ((0.05, 0.99), (0.1, 0.98), (0.15, 0.96), (0.2, 0.9)):
        one = [text(n, r) for _ in range(150)]
        two = [edited(x, share, r) for x in one]
        t = textops.tokens(pa.array(one + two), textops.word_bytes(), textops.byte_values())
        keys = near.order_minhash(*textops.ngrams(t, near.WORDS)).reshape(300, near.FUNCTIONS, near.PAIRS)
        words = [t.hashes[a:b] for a, b in zip(t.starts[:-1], t.starts[1:], strict=True)]
        hit = [any(len(np.intersect1d(*k)) for k in zip(keys[i], keys[150 + i], strict=True)) for i in range(150) if alike(words[i], words[150 + i], near.SIMILARITY)]
        assert len(hit) >= 100 and np.mean(hit) >= least, (share, np.mean(hit))


def test_keys_of_short_texts():
    t = textops.tokens(pa.array(["a b", "a b c d e", "a b c d e f", "x y z a b c", "b c d e f g h"]), textops.word_bytes(), textops.byte_values())
    keys = [set(k.tolist()) for k in near.order_minhash(*textops.ngrams(t, near.WORDS)).reshape(5, -1)]
    assert len(keys[0]) == len(keys[1]) == 1 and keys[1] < keys[2] | keys[1] and not keys[0] & keys[1]
    assert not keys[3] & (keys[0] | keys[1] | keys[2] | keys[4])


def test_repeated_ids_are_judged_by_text(spark):
    r = random.Random(41)
    one, two, clean = text(50, r), text(50, r), text(50, r)
    rows = [(1, one), (5, one + " end"), (5, clean), (6, one + " other"), (8, two), (8, two + " more"), (None, one + " null")]
    kept = Counter((x.doc_id, x.text) for x in near.keep_one(docs(spark, rows[:6])).collect())
    assert kept[1, one] == kept[5, clean] == 1 and not kept[5, one + " end"] and not kept[6, one + " other"]
    assert kept[8, two] + kept[8, two + " more"] == 1 and kept.total() == 3
    assert {(x.doc_id, x.text) for x in near.keep_one(docs(spark, rows)).collect()} >= {(None, one + " null"), (5, clean)}


def test_names_that_clash(spark):
    rows = [(i, text(30), i, "of", i) for i in range(6)]
    table = spark.createDataFrame([*rows, (7, rows[0][1] + " end", 1, "x", 2), (8, rows[1][1], 1, "x", 2), (8, rows[2][1] + " w1", 3, "y", 4)], "doc_id long, text string, of int, own string, Gone int")
    found = near.keep_one(table)
    assert found.columns == table.columns and sorted(map(str, found.collect())) == sorted(map(str, table.filter("doc_id < 6").collect()))


def test_large_groups_go_on_without_loss(spark, monkeypatch):
    for name, value in (("FEW", 2), ("BLOCK_DEPTH", 4), ("BLOCK", 3), ("DEPTH", 3), ("LEADERS", 2)):
        monkeypatch.setattr(near, name, value)
    passage = text(60)
    rows = [(i, f"{passage} {text(12)}") for i in range(12)]
    rows += [(100 + i, edited(rows[i][1], 0.03)) for i in range(12)]
    words = {i: np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for i, t in rows}
    links = [(a, b) for a in words for b in words if a < b and alike(words[a], words[b], 0.9)]
    got = defaultdict(set)
    for r in near.classes(docs(spark, rows), similarity=0.9).collect():
        got[r.class_id].add(r.id)
    assert sorted(map(sorted, got.values())) == parts_of(links, words)


def test_every_pair_with_a_common_key_is_settled(spark, monkeypatch):
    """Groups over FEW by a passage in all texts: pairs of worn copies share few keys, and their leader is another text."""
    for name, value in (("FEW", 2), ("BLOCK", 9)):
        monkeypatch.setattr(near, name, value)
    r = random.Random(90)
    passage = text(20, r)
    rows = []
    for i in range(40):
        one = text(70, r).split()
        rows += [(2 * i, f"{passage} {' '.join(one)}"), (2 * i + 1, f"{passage} {' '.join(replaced(one, range(4, 70, 5)))}")]
    t = textops.tokens(pa.array([x for _, x in rows]), textops.word_bytes(), textops.byte_values())
    words = [t.hashes[a:b] for a, b in zip(t.starts[:-1], t.starts[1:], strict=True)]
    keys = near.order_minhash(*textops.ngrams(t, near.WORDS)).reshape(len(rows), near.FUNCTIONS, near.PAIRS)
    met = lambda i, j: any(len(np.intersect1d(*k)) for k in zip(keys[i], keys[j], strict=True))
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if met(i, j) and alike(words[i], words[j], near.SIMILARITY)]
    got = defaultdict(set)
    for x in near.classes(docs(spark, rows)).collect():
        got[x.class_id].add(x.id)
    assert sorted(map(sorted, got.values())) == parts_of(links, [i for i, _ in rows])


def test_compact_windows_cover_every_stretch():
    r = random.Random(4)
    for _ in range(60):
        sizes = [r.randint(0, 30) for _ in range(3)]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        h = np.array([r.randrange(2**63) for _ in range(starts[-1])], np.uint64)
        least = r.randint(1, 6)
        found = list(zip(*(x.tolist() for x in passages.compact_windows(h, starts, least)), strict=True))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            for i in range(a, b):
                for j in range(i + least - 1, b):
                    c = i + int(h[i : j + 1].argmin())
                    assert sum(x <= i <= y <= j <= z and y == c for x, y, z in found) == 1


def test_passages(spark):
    shared, other = text(60), text(55)
    rows = [(1, f"{text(30)} {shared} {text(30)}"), (2, f"{text(10)} {shared}"), (3, f"{shared.upper()}! {text(80)}"), (4, text(200)), (5, f"{text(40)} {edited(shared, 0.03)} {text(5)}")]
    rows += [(6, f"{text(20)} {' '.join(shared.split()[:40])} {text(20)}"), (7, other), (8, other), (9, "short one"), (10, None), (11, ""), (None, other), (12, f"{text(9)} {other}"), (12, f"{text(3)} {other}"), (13, text(100) + " a b" * 2000)]
    found = {r.id: (r.start, r.end, r.lead) for r in passages.merged(passages.repeated_passages(docs(spark, rows))).collect()}
    nameless = [i for i in found if i < passages.NAMELESS]
    assert set(found) - set(nameless) == {1, 2, 3, 5, 7, 8, 12} and [found.pop(i)[:2] for i in nameless] == [(0, 55)]
    assert found[1] == (30, 90, 1) and found[2] == (10, 70, 1) and found[3] == (0, 60, 1) and found[8][:2] == (0, 55)
    assert abs(found[5][0] - 40) <= 3 and found[5][2] == 1
    assert passages.repeated_passages(docs(spark, rows).limit(0)).count() == 0


def test_same_stretches_against_plain():
    r = random.Random(9)
    for _ in range(200):
        a, b = (np.array([r.randrange(3) for _ in range(r.randint(0, 40))], np.uint32) for _ in "ab")
        plain = lambda x, y: {i for i in range(len(x) - 4) if any((x[i : i + 5] == y[j : j + 5]).all() for j in range(len(y) - 4))}
        in_a, in_b = passages.same_stretches(a, b, 5)
        for x, y, spans in ((a, b, in_a), (b, a, in_b)):
            starts = plain(x, y)
            assert {i for s, e in spans for i in range(s, e)} == {i + j for i in starts for j in range(5)}


def test_no_exact_passage_is_lost(spark):
    """Passages of 50 to 70 words in two documents; a lesser one holds pieces of them, some twice, and a common phrase in all texts."""
    r, rows, truth = random.Random(77), [], {}
    common = text(9, r)
    for k in range(60):
        n = r.randint(50, 70)
        shared = text(n, r).split()
        piece = " ".join(shared[: r.randint(40, 48)])
        tail = " ".join(shared[-45:])
        lead = {0: f"{text(20, r)} {piece} {text(15, r)} {tail}", 1: f"{piece} {text(12, r)} {' '.join(shared)}", 2: f"{common} {piece} {common}"}[k % 3]
        rows.append((1000 + k, f"{lead} {common}"))
        for at in (3000, 5000):
            before = text(r.randint(0, 60), r).split()
            rows.append((at + k, " ".join([*before, *shared, *common.split(), *text(20, r).split()])))
            truth[at + k] = (len(before), len(before) + n)
    r.shuffle(rows)
    held = defaultdict(set)
    for x in passages.merged(passages.repeated_passages(docs(spark, rows))).collect():
        held[x.id] |= set(range(x.start, x.end))
    assert all(set(range(a, b)) <= held[i] for i, (a, b) in truth.items())
    assert all(set(held[1000 + k]) for k in range(1, 60, 3))


def test_recall_of_edited_passages(spark):
    r, rows, places = random.Random(78), [], {}
    number = 0
    for n, share in ((60, 0.05), (60, 0.1), (100, 0.05), (100, 0.1), (100, 0.15)):
        for _ in range(60):
            shared = text(n, r).split()
            worn = replaced(shared, set(r.sample(range(1, n - 1), round(n * share))))
            for words in (shared, worn):
                number += 1
                before = text(r.randint(0, 40), r)
                rows.append((number, f"{before} {' '.join(words)} {text(30, r)}"))
                places[number] = (n, share)
    found = {x.id for x in passages.repeated_passages(docs(spark, rows)).select("id").distinct().collect()}
    for kind in sorted(set(places.values())):
        own = [i for i, k in places.items() if k == kind]
        assert np.mean([i in found for i in own]) >= 0.9, kind


def test_windows_have_room_for_edits(spark):
    """Two windows of a worn passage need less room than a whole one's: of 300 passages of 60 words with 10 % replaced 0.97 meet."""
    r, rows = random.Random(83), []
    for k in range(300):
        shared = text(60, r).split()
        places = set(r.sample(range(1, 59), 6))
        worn = [f"y{r.randrange(10**9)}" if i in places else w for i, w in enumerate(shared)]
        rows += [(2 * k + i, f"{text(r.randint(0, 40), r)} {' '.join(words)} {text(30, r)}") for i, words in enumerate((shared, worn))]
    couples = {(x.lead, x.id) for x in passages.pairs(passages.members(passages.windows(docs(spark, rows)))).collect()}
    assert np.mean([(2 * k, 2 * k + 1) in couples for k in range(300)]) >= 0.97


def test_words_rule_passages_out_without_loss(monkeypatch):
    """What both ways of comparing give, and no alignment where the words in common leave no room for a passage."""
    r = random.Random(84)
    for k in range(200):
        shared = text(r.randint(30, 90), r).split()
        worn = edited(" ".join(shared), r.choice([0, 0.05, 0.15, 0.2, 0.25, 0.3]), r).split()
        a, b = ([*text(r.randint(0, 60), r).split(), *words, *text(r.randint(0, 60), r).split()] for words in (shared, worn))
        if k % 10 == 0:
            b = a
        a, b = (np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint32) for words in (a, b))
        assert passages.both_passages(a, b) == (passages.common_passages(a, b), *passages.same_stretches(a, b))
    monkeypatch.setattr(passages, "common_passages", None)
    one, two = (np.array([hash(w) & 0xFFFFFFFF for w in text(400, r).split()], np.uint32) for _ in range(2))
    assert passages.both_passages(np.append(one, two[:30]), two) == ([], [], [])
    for n in range(4):
        whole = passages._aligned(np.arange(n), np.arange(10, 14), True)
        assert whole.tolist() == [passages.ONLY_B] * (4 - n) + [passages.OTHER] * n and not len(passages._aligned(np.arange(n), np.arange(10, 14), False))


def test_edited_passages_of_two_greater_documents(spark):
    """A lesser document holds the first 45 words, so it leads the groups of their tokens; the others share an edited passage."""
    r, rows = random.Random(80), []
    for k in range(30):
        shared = text(60, r).split()
        worn = replaced(shared, {10, 22, 34, 46})
        rows += [(k, f"{text(30, r)} {' '.join(shared[:45])} {text(30, r)}"), (1000 + k, f"{text(20, r)} {' '.join(shared)} {text(20, r)}"), (2000 + k, f"{text(9, r)} {' '.join(worn)} {text(20, r)}")]
    couples = {(x.lead, x.id) for x in passages.pairs(passages.members(passages.windows(docs(spark, rows)))).collect()}
    assert np.mean([(1000 + k, 2000 + k) in couples for k in range(30)]) >= 0.9


def replaced(words, places):
    return [f"z{R.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]


def test_edited_passages_are_aligned_whole():
    r, hashes = random.Random(31), {}
    coded = lambda words: np.array([hashes.setdefault(w, len(hashes)) for w in words], np.uint32)
    for n, places in ((51, {25}), (52, {1, 50}), (60, {10, 15, 20, 40, 45, 58}), (80, set(range(5, 80, 10))), (100, {*range(6, 99, 6)} - {96})):
        shared, before, after = text(n, r).split(), text(30, r).split(), text(30, r).split()
        a = coded(before + shared + after)
        b = coded(text(12, r).split() + replaced(shared, places) + text(40, r).split())
        assert passages.common_passages(a, b) == [(30, 30 + n, 12, 12 + n)], n
    for n in (40, 49):
        shared = text(n, r).split()
        assert not passages.common_passages(coded(text(30, r).split() + shared), coded(shared + text(30, r).split()))
    one, two = text(60, r).split(), text(70, r).split()
    a, b = one + text(200, r).split() + two, two[:35] + ["q1", "q2"] + two[35:] + text(90, r).split() + one
    assert passages.common_passages(coded(a), coded(b)) == [(260, 330, 0, 72), (0, 60, 162, 222)]


def test_benchmark_leaks(spark):
    items = [(i, text(R.randint(15, 40))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 w2 nowhere"), (93, "")]
    rows = [(i, f"{text(40)} {items[i][1]} {text(30)}") for i in range(10)]
    rows += [(20 + i, f"{text(10)} {edited(items[10][1], 0.05)} {text(300)}") for i in range(80)]
    rows += [(200 + i, text(150)) for i in range(30)] + [(300, None), (301, ""), (302, "w1 w2"), (303, text(20_000)), (None, items[3][1]), (0, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(docs(spark, rows), benchmark).collect()
    hits = {(r.id, r.item_id) for r in found}
    assert {(i, i) for i in range(10)} <= hits
    assert {i for i, _ in hits} >= set(range(20, 100)) and not {i for i, _ in hits} & set(range(200, 304))
    kept = decontam.clean(docs(spark, rows), benchmark)
    assert kept.columns == ["doc_id", "text", "id", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(200, 230), 300, 301, 302, 303]
    assert decontam.leaks(docs(spark, rows), benchmark.limit(0)).count() == 0
    assert decontam.clean(docs(spark, rows).limit(0), benchmark).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    items = [(i, text(20)) for i in range(12)]
    rows = [(i, f"{text(10)} {t} {text(10)}") for i, t in items]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    found = decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}


def test_many_edited_copies_of_an_item(spark):
    r = random.Random(21)
    item = text(23, r).split()
    worn = [f"x{i}" if i in (4, 9, 14, 18) else w for i, w in enumerate(item)]
    split = text(100, r).split()
    wide = split[:50] + [f"y{i}" for i in range(34)] + split[50:]
    rows = [(i, f"{text(20, r)} {' '.join(worn)} {text(20, r)}") for i in range(60)]
    rows += [(100 + i, text(80, r)) for i in range(5)] + [(200, f"{text(30, r)} {' '.join(wide)} {text(30, r)}"), (300, " ".join(item[:6] + ["z"] * 30))]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(split))], "item_id long, text string")
    found = {(x.id, x.item_id): round(x.similarity * (23 if x.item_id == 1 else 100)) for x in decontam.leaks(docs(spark, rows), benchmark).collect()}
    assert found == {(i, 1): 15 for i in range(60)} | {(200, 2): 66}
    assert sorted(x.doc_id for x in decontam.clean(docs(spark, rows), benchmark).collect()) == [*range(100, 105), 300]


def test_leaks_against_all_pairs():
    r = random.Random(5)
    some = [f"v{i}" for i in range(400)]
    items = [r.choices(some, k=n) for n in (1, 2, 3, *range(4, 20), 24, 33, 50) for _ in range(6)]
    def changed(words, how):
        out = list(words)
        for i in r.sample(range(len(out)), len(out) // 5):
            out[i] = None if how == "less" else f"q{i}"
        out = [w for w in out if w]
        if how == "more":
            for _ in range(len(words) // 8):
                out.insert(r.randrange(len(out)), "zz")
        return out

    texts, kinds = [], []
    for item in items:
        for how in ("replaced", "less", "more", "whole"):
            copy = item if how == "whole" else changed(item, how)
            texts.append(r.choices(some, k=8) + copy + r.choices(some, k=9))
            kinds.append(how)
    known = decontam.Items([" ".join(x) for x in items])
    found = {m[:2] for m in decontam.matches(pa.array([" ".join(x) for x in texts]), known, decontam.Screen(known.grams), textops.byte_values())}
    code = {w: j + 2 for j, w in enumerate({w for x in items + texts for w in x})}
    wide = max(map(len, texts))
    right = np.array([[code[w] for w in x] + [1] * (wide - len(x)) for x in texts], np.uint64)
    truth = set()
    for j, item in enumerate(items):
        score, _ = decontam.smith_waterman(np.tile(np.array([code[w] for w in item], np.uint64), (len(texts), 1)), right)
        truth |= {(i, j) for i in np.flatnonzero(score >= (decontam.LEAST if len(item) >= decontam.SHORT else 1.0) * len(item) - 1e-9).tolist()}
    assert found <= truth
    planted = lambda how: {(i, j) for i, j in truth if i // 4 == j and kinds[i] == how}
    for how in ("whole", "replaced", "less"):
        assert planted(how) <= found
    assert {(4 * j + 3, j) for j in range(len(items))} <= found
    assert len(found) >= 0.95 * len(truth) and len(planted("more") & found) >= 0.95 * len(planted("more"))


def test_smith_waterman():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randrange(2, 6) for _ in range(r.randint(1, n))] for n in (9, 12))
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
            best, row = max(best, *new), new
        left, right = np.zeros((1, len(a) + 2), np.uint64), np.ones((1, len(b) + 3), np.uint64)
        left[0, : len(a)], right[0, : len(b)] = a, b
        assert decontam.smith_waterman(left, right)[0][0] == best


def plain_shares(nodes, budget):
    """Shares by weight, none over its room; what is lacking goes to the others."""
    given, open_ = {}, dict(nodes)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, room) in open_.items() if budget * w / total >= room]
        if not full:
            return given | {k: budget * w / total for k, (w, _) in open_.items()}
        for k in full:
            given[k] = float(open_.pop(k)[1])
        budget -= sum(given[k] for k in full)
    return given


def test_mix_against_plain(spark):
    mix = mixing.Mix(domains={"web": 3, "*": 1}, langs={"en": 2, "*": 1}, sources={"*": 1}, domain_of={"s0": "web", "s1": "web"}, percent=70, epochs=3)
    rows = [(i, R.choice([text(R.randint(1, 30)), text(3), ""]), R.choice(["en", "de", None]), R.choice(["s0", "s0", "s1", "s2", None])) for i in range(400)] + [(400, None, "en", "s0"), (401, " \n", "en", "s0"), (3, "again w1", "en", "s0")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, domain string")
    counted = mixing.counted(table, mix)
    leaves = defaultdict(int)
    for _, t, lang, source in rows:
        leaves[mix.domain_of.get(source or "?", "other"), lang or "?", source or "?"] += len((t or "").split())
    leaves = {k: n for k, n in leaves.items() if n}
    room = lambda *key: sum(n * mix.epochs for k, n in leaves.items() if k[: len(key)] == key)
    weight = lambda w, k: w.get(k, w["*"])
    truth = {}
    top = {k[0]: (weight(mix.domains, k[0]), room(k[0])) for k in leaves}
    for d, b in plain_shares(top, sum(leaves.values()) * mix.percent // 100).items():
        for lang, c in plain_shares({k[1]: (weight(mix.langs, k[1]), room(d, k[1])) for k in leaves if k[0] == d}, b).items():
            for s, x in plain_shares({k[2]: (1, room(d, lang, k[2])) for k in leaves if k[:2] == (d, lang)}, c).items():
                truth[d, lang, s] = x
    selected = mixing.selected(counted, mixing.cuts(counted, mix), mix).collect()
    taken, count = defaultdict(int), Counter()
    for r in selected:
        taken[r.domain, r.lang, r.source] += r.n_tokens
        count[r.id, r.epoch, r.n_tokens] += 1
    for k, budget in truth.items():
        assert budget - 30 <= taken[k] <= budget + 1e-6, (k, budget, taken[k])
    assert max(e for _, e, _ in count) <= mix.epochs - 1
    whole = mixing.mixed(table, mix)
    assert whole.columns == [*table.columns, "epoch", "n_tokens"]
    assert Counter((r.doc_id, r.epoch, r.n_tokens) for r in whole.collect()) == count
    assert mixing.mixed(table.limit(0), mix).count() == 0


def test_mix_of_equal_rows_keeps_its_budget(spark):
    mix = mixing.Mix(domains={"*": 1}, langs={"*": 1}, sources={"*": 1}, percent=50, epochs=1)
    for number in (lambda i: None,):
        for words in (lambda i: "a b c", lambda i: f"a b w{i}"):
            table = spark.createDataFrame([(number(i), words(i), "en", "s", "x", 5) for i in range(1000)], "doc_id long, text string, lang string, source string, Epoch string, n_tokens int").repartition(7)
            found = mixing.mixed(table, mix)
            assert found.columns == ["doc_id", "text", "lang", "source", "epoch", "n_tokens"]
            assert [r.n_tokens for r in found.collect()] == [3] * 500
    rows = [(i % 40, f"w{i % 60} " * (1 + i % 3), "en", f"s{i % 2}") for i in range(480)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent in (37, 90):
        mix = mixing.Mix(domains={"*": 1}, langs={"*": 1}, sources={"s0": 2, "*": 1}, percent=percent, epochs=2)
        counted = mixing.counted(table, mix)
        truth = Counter(query(spark, table, mixing.op3_sql(mix)))
        assert Counter((r.id, r.source, r.n_tokens, r.epoch) for r in mixing.selected(counted, mixing.cuts(counted, mix), mix).collect()) == truth
        assert Counter((r.doc_id, r.source, r.n_tokens, r.epoch) for r in mixing.mixed(table, mix).collect()) == truth


def query(spark, table, sql):
    import duckdb

    documents = table.toPandas()  # noqa: F841
    return [tuple(r) for r in duckdb.sql(f"SELECT doc_id, source, n_tokens, epoch FROM ({sql})").fetchall()]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tokens_and_ngrams_against_plain(n):
    texts = ["", "a b a", "É é, x-y 12", "  ", "one", "a b c d e f g"]
    t = textops.tokens(pa.array(texts), textops.word_bytes(), textops.byte_values())
    import re

    plain = [re.findall(r"[^\W_]+", x) for x in texts]
    assert np.diff(t.starts).tolist() == [len(p) for p in plain]
    grams, starts = textops.ngrams(t, n)
    seen = {}
    for i, p in enumerate(plain):
        own = [tuple(p[j : j + n]) for j in range(max(len(p) - n + 1, min(len(p), 1)))]
        assert starts[i + 1] - starts[i] == len(own)
        for g, h in zip(own, grams[starts[i] : starts[i + 1]].tolist(), strict=True):
            assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_members_of_groups_are_shuffled_once(spark):
    members = spark.range(40).selectExpr("id % 13 + if(id > 30, id, 0) as bucket", "0 as band", "cast(cast(id as string) as binary) as node")
    found = near._groups(members)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.bucket, []).append(bytes(r.node))
    truth = {(b, n, min(g), len(g)) for b, g in groups.items() if len(g) > 1 for n in g}
    assert {(r.bucket, bytes(r.node), bytes(r.leader), r.n) for r in found.collect()} == truth
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near, "stored", lambda df: made.append(df) or df)
        near._groups(members)
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_texts_of_several_groups_are_aligned_once(monkeypatch):
    calls, plain = [], near.alike
    monkeypatch.setattr(near, "alike", lambda x, y, s: calls.append(1) or plain(x, y, s))
    r = np.random.default_rng(5)
    words = [r.permutation(np.arange(40, dtype=np.uint32)).tobytes() for _ in range(4)]
    whole = pd.DataFrame({"node": [b"a", b"b", b"c", b"d"], "component": [1, 2, 3, 4], "words": words, "also": [[1, 2], [2, 1], [1, 2], [2]], "before": [None] * 4})
    for bucket, some in ((1, whole[:3]), (2, whole)):
        assert near.between(some.reset_index(drop=True), None, 0.8, bucket) == []
    assert len(calls) == 6  # nine pairs in the two groups, six distinct ones
    later = whole.assign(before=[[7], [7], None, [7]])
    near.between(later, None, 0.8, 2)
    assert len(calls) == 7  # the last text was in no group with the third before
    whole.loc[3, "words"] = words[0]
    assert near.between(whole, None, 0.8, 2) == [(b"a", b"d")]
