"""Where scratch tables go."""

import types

import pytest

from scholion.llm import common


def session(master, setting=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: setting)
    context = types.SimpleNamespace(master=master, applicationId="app", getConf=lambda: conf)
    return types.SimpleNamespace(conf=conf, sparkContext=context)


def test_the_cluster_names_the_folder():
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]"])
def test_a_cluster_without_one_fails(master):
    with pytest.raises(ValueError, match="shared folder"):
        common.shared_dir(session(master))


@pytest.mark.parametrize("master", ["local", "local[*]"])
def test_one_machine_gets_its_own(master):
    assert common.shared_dir(session(master)) == common.shared_dir(session(master)) and common.shared_dir(session(master)).startswith("file:///")
