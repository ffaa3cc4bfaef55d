"""Checkpoint folder rules: shared setting used, scratch only in local mode."""

from __future__ import annotations

import pytest

from sessionflow.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, ckpt=None):
        self.master = master
        self.ckpt = ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, path):
        self.ckpt = path


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, ckpt)


def test_shared_setting_is_used_and_applied():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs://nn/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://nn/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs://nn/ckpt"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_local_mode_gets_a_scratch_folder():
    s = _Session("local[4]")
    path = ensure_checkpoint_dir(s)
    assert path and s.sparkContext.getCheckpointDir() == path
    assert ensure_checkpoint_dir(s) == path  # stable afterwards
