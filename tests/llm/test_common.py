from __future__ import annotations

from types import SimpleNamespace

import pytest

from lapidary.llm.common import shared_folder


def session(master, **settings):
    conf = {"spark.sql.warehouse.dir": "file:/somewhere/warehouse", **{k.replace("_", "."): v for k, v in settings.items()}}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=SimpleNamespace(master=master))


def test_no_local_folder_on_a_cluster():
    assert shared_folder(session("yarn", spark_checkpoint_dir="hdfs://x/c")) == "hdfs://x/c"
    assert shared_folder(session("local[4]")) == "file:/somewhere/warehouse/checkpoints"
    assert shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "s3a://b/w"})) == "s3a://b/w/checkpoints"
    for master in ("yarn", "spark://host:1", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
