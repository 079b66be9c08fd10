"""Shared storage: scratch tables and where they may lie."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from gleaner import session


def paths(df) -> list[str]:
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with session.scratch(spark) as keep_outer:
        with session.scratch(spark) as keep:
            gone = session.materialize(spark.range(5), "gone")
            kept = keep(session.materialize(gone.selectExpr("id + 1 AS id"), "kept"))
            empty = keep(session.materialize(gone.where("id > 9"), "empty"))
            names = paths(gone)
        assert names and not any(map(os.path.exists, names))
        assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4, 5] and empty.count() == 0
        last = keep_outer(session.materialize(kept, "last"))
        names = paths(kept)
    assert not any(map(os.path.exists, names)) and last.count() == 5


def test_plain_files_have_no_checksum_files(spark):
    made = [session.materialize(spark.range(5), "files", plain) for plain in (False, True)]
    assert [any(name.endswith(".crc") for name in os.listdir(os.path.dirname(paths(df)[0]))) for df in made] == [True, False]
    assert all(df.count() == 5 for df in made)


def test_a_cluster_must_name_its_shared_folder():
    def asked(master: str, named: str | None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))

    assert session.shared_dir(asked("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        session.shared_dir(asked("yarn", None))
    with pytest.raises(ValueError):
        session.shared_dir(asked("local-cluster[2,1,1024]", None))
