"""Tables of the shared folder."""

import os

import pytest
from vesselwatch import session


def test_stored_tables_are_read_back_and_discarded(spark):
    kept, gone = (session.stored(spark.range(n).toDF("n"), "probe") for n in (3, 5))
    folders = [f.split("/part-")[0].removeprefix("file://").removeprefix("file:") for df in (kept, gone) for f in df.inputFiles()[:1]]
    assert all(f.startswith(session.shared_dir(spark).removeprefix("file://")) and os.path.isdir(f) for f in folders)
    session.discard(gone)
    assert [os.path.isdir(f) for f in folders] == [True, False] and kept.count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "_setting", lambda _: None)
    own = session.shared_dir(spark)
    assert own.startswith("file:///") and own == session.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="driver and executors share"):
        session.shared_dir(spark)
