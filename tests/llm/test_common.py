from types import SimpleNamespace

import pytest

from worktrace.llm import common


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "s3a://bucket/shared/")) == "s3a://bucket/shared"
    for master in ("local", "local[4]", "local[*]"):
        assert common.shared_dir(session(master)).startswith("file://")
