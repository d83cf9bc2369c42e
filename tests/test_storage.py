"""Tables in the shared folder."""

import os

from chronocore.plans import storage


def test_stored_small_and_release(spark):
    df = storage.stored(spark.range(10))
    folder = storage.session_dir(spark)
    assert df.count() == 10 and os.path.isdir(folder) and folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert storage.small(df, 10) and not storage.small(df, 9)
    other = spark.newSession()
    assert storage.shared_dir(other) == storage.shared_dir(spark)
    storage.release(spark)
    assert not os.path.exists(folder)


def test_parted_and_forgotten(spark):
    rows = spark.range(10).selectExpr("id", "id % 2 = 0 as even")
    even, odd = storage.parted(rows, "even", ["true", "false"])
    assert even.columns == ["id"] and sorted(r.id for r in even.collect()) == [0, 2, 4, 6, 8] and odd.count() == 5
    none, all_ = storage.parted(rows.filter("not even"), "even", ["true", "false"])
    assert none.count() == 0 and all_.count() == 5
    files = even.inputFiles()
    storage.forget(even)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files) and odd.count() == 5
    storage.forget(none)


def test_no_private_folder_on_a_cluster():
    class Session:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077"})

    import pytest

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session)


def test_batches_are_lowered_and_never_raised(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    session.conf.set(key, "64m")
    storage.lean(session)
    assert session.conf.get(key) == str(storage.BATCH_BYTES)
    session.conf.set(key, "1m")
    storage.lean(session)
    assert session.conf.get(key) == "1m"
