"""Checkpoint folder resolution."""

import os
from types import SimpleNamespace

import pytest

from leafcast import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Session:
    def __init__(self, value, master="local[2]"):
        self.conf = _Conf(value)
        self.sparkContext = SimpleNamespace(master=master)


def test_cluster_folder_is_used_as_named():
    assert session.checkpoint_dir(_Session("hdfs://nn/shared/ckpt")) == "hdfs://nn/shared/ckpt"


def test_scratch_folder_only_when_unset_and_stable():
    a = session.checkpoint_dir(_Session(None))
    assert os.path.isdir(a) and session.checkpoint_dir(_Session("")) == a


def test_a_cluster_without_a_named_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_Session(None, "spark://host:7077"))
