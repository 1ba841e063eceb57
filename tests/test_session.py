"""Where intermediate tables go."""

import pytest

from tracewell import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value


class _Context:
    def __init__(self, master, current):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path

    def getConf(self):
        return _Conf(None)


class _Session:
    def __init__(self, master, current=None, setting=None):
        self.sparkContext, self.conf = _Context(master, current), _Conf(setting)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(_Session(master))
    assert session.ensure_checkpoint_dir(_Session(master, setting="hdfs://x/shared")) == "hdfs://x/shared"
    assert session.ensure_checkpoint_dir(_Session(master, current="hdfs://x/set")) == "hdfs://x/set"


def test_a_local_master_gets_a_scratch_folder():
    assert session.ensure_checkpoint_dir(_Session("local[4]")).startswith("/tmp/")
