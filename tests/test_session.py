"""Intermediates of a run: where they are, and how they end."""

import os

from flowspark import session as sessions
from flowspark.session import cut_lineage, drop_run, run_folder


def test_a_run_is_dropped_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "checkpoint_dir", lambda _: str(tmp_path))
    session = spark.newSession()
    drop_run(session)
    first = cut_lineage(session.range(3), "numbers")
    cut_lineage(session.range(4), "numbers")
    folder = run_folder(session)
    assert first.count() == 3 and len(os.listdir(folder)) == 2 and os.path.dirname(folder) == str(tmp_path)
    (tmp_path / "other").mkdir()
    drop_run(session)
    assert os.listdir(tmp_path) == ["other"]
    assert cut_lineage(session.range(5), "numbers").count() == 5 and run_folder(session) != folder
    drop_run(session)
