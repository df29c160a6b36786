"""Cut tables: where they go and that they go away."""

import os

import pytest
from types import SimpleNamespace

from palimpsest.plans import runtime


def test_cut_tables_are_swept(spark):
    df = runtime.cut(spark.range(10), "t")
    assert df.count() == 10
    path = runtime._written[-1][1].removeprefix("file://")
    assert os.path.isdir(path)
    runtime.sweep()
    assert not os.path.exists(path) and not runtime._written


def test_no_folder_of_one_machine_on_a_cluster():
    none = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://head:7077", "local-cluster[2,1,1024]", "yarn"):
        far = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(far)
