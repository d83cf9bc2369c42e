"""Text and Parquet forms: round trips, strict and permissive reading, streaming ingestion."""

import pytest

from chronocore.operators import edges, staircase
from chronocore.plans.storage import stored
from chronocore.sources import edge_list, index_files
from chronocore.streaming.ingest import ingest

TEXT = "# comment\n\n9\n10 20 0\n20 30 1 55 x\n 30\t10 2\n10 20 2\n% more\n20 10 5\n30 40 9\n40 30 9\n7 7 3\n30 20 6\n"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def graph(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TEXT)
    return stored(edges.interned(edge_list.read(spark, str(tmp_path / "g.txt"))))


def test_strict_reading(spark, graph, tmp_path):
    assert rows(graph) == [(0, 0, 1, 0), (1, 1, 2, 1), (2, 0, 1, 2), (3, 0, 2, 2), (4, 0, 1, 5), (5, 1, 2, 6), (6, 2, 3, 9)]
    for i, (text, line) in enumerate({"1 2\n": 1, "1 2 3\n4 5 6x\n": 2, "1 2 3\n4\n": 2, "1\n2\n1 2 3\n": 2, "1 2 -3\n": 1, "# none\n": None, "1 2 99999999999999999999\n": 1}.items()):
        (tmp_path / f"bad{i}.txt").write_text(text)
        with pytest.raises(ValueError, match=f":{line}:" if line else "no edges"):
            edge_list.read(spark, str(tmp_path / f"bad{i}.txt"))
    with pytest.raises(ValueError, match="unknown mode"):
        edge_list.read(spark, str(tmp_path / "g.txt"), "other")


def test_permissive_reading(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2\n1 2 3x\n123\n4 5 -6\nabc\n7 8 9 10\n")
    assert rows(edge_list.read(spark, str(tmp_path / "p.txt"), "permissive").select("u", "v", "t")) == [(1, 2, 3), (7, 8, 9)]


def test_index_round_trips(spark, graph, tmp_path):
    ix = stored(staircase.staircases(graph, 0, 9))
    index_files.write_text(graph, ix, str(tmp_path / "text"), 0, 9)
    e, back, floor, dmax = index_files.read_text(spark, str(tmp_path / "text"))
    assert (rows(e), rows(back), floor, dmax) == (rows(graph), rows(ix), 0, 9)
    index_files.write_tables(graph, ix, str(tmp_path / "tables"), 0, 9)
    e, back, said = index_files.read_tables(spark, str(tmp_path / "tables"))
    assert (rows(e), rows(back), said["edges"]) == (rows(graph), rows(ix), 7)


def test_broken_text_index(spark, tmp_path):
    head = index_files.HEADER.format(floor=0, dmax=9)
    for i, body in enumerate(["0 1 0 | base=1 ; 2:2 1:3", "0 1 0 | base=1 ; 2:1", "0 1 0 | base=1 ; 12:2", "0 1 0 base=1"]):
        (tmp_path / f"i{i}.txt").write_text(f"{head}\n{body}\n")
        with pytest.raises(ValueError):
            index_files.read_text(spark, str(tmp_path / f"i{i}.txt"))
    (tmp_path / "none.txt").write_text("0 1 0 | base=1 ;\n")
    with pytest.raises(ValueError, match="no header"):
        index_files.read_text(spark, str(tmp_path / "none.txt"))


def test_ingestion_adds_each_edge_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("1 2 3\n2 1 3\n5 5 1\n", "1 2 3\n3 4 5\nbroken\n")):
        (tmp_path / f"in/{i}.txt").write_text(text)
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "table")).select("u", "v", "t")) == [(1, 2, 3), (3, 4, 5)]
