from __future__ import annotations

from types import SimpleNamespace

import pytest

from forgeboard.session import shared_dir


def session(master: str, **settings: str):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_cluster_names_the_shared_folder():
    given = session("yarn", spark_checkpoint_dir="hdfs:///shared/")
    first, second = shared_dir(given, "x"), shared_dir(given, "x")
    assert first.startswith("hdfs:///shared/x-") and first != second


def test_a_local_folder_only_in_local_mode():
    assert "/forgeboard-" in shared_dir(session("local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"), "x")
