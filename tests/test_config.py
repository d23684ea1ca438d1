import json
import os

import pytest

from tensorfold.errors import InvalidConfig, UnknownSource
from tensorfold.plans import config as G


def test_layers():
    c = G.Config.from_dict({"source": "mount", "nonsense": 1, "parallel": {"queue_size": 3}, "debug": {"debug_log": True}, "mount": {"mount_point": "/m", "queue_size": 9}, "copy": {"x": 1}})
    assert (c.source, c.queue_size, c.debug_log) == ("mount", 3, True)
    assert c.section("mount") == {"mount_point": "/m"} and c.section("copy") == {"x": 1} and c.section("none") == {}
    assert c.pipeline_options()["queue_size"] == 3
    off = G.Config.from_dict({"use_pipeline": False, "show_progress": False})
    assert off.pipeline_options() == {"queue_size": -1, "show_progress": False, "max_concurrent_producers": 1}
    assert "source=mount" in c.summary()


def test_errors():
    with pytest.raises(InvalidConfig):
        G.Config(max_concurrent_producers=2)
    with pytest.raises(UnknownSource):
        G.source("nope")


def test_discovery(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(G.ENV, raising=False)
    assert G.load_config() == G.Config()
    (tmp_path / G.DEFAULT_FILE).write_text(json.dumps({"queue_size": 1}))
    assert G.load_config().queue_size == 1
    (tmp_path / "own.json").write_text(json.dumps({"queue_size": 2}))
    monkeypatch.setenv(G.ENV, str(tmp_path / "own.json"))
    assert G.load_config().queue_size == 2
    monkeypatch.setenv(G.ENV, str(tmp_path / "missing.json"))
    with pytest.raises(FileNotFoundError):
        G.load_config()


def test_workspace_is_shared_or_refused(spark):
    from types import SimpleNamespace

    from tensorfold.errors import NoWorkspace
    from tensorfold.plans.workspace import local_folder, workspace

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert workspace(spark) == spark.conf.get("spark.checkpoint.dir")
    assert workspace(session("spark://x:1", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://x:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(NoWorkspace):
            workspace(session(master))
    with pytest.raises(NoWorkspace):
        local_folder(session("yarn", "hdfs://a/b"), "x")
    own = workspace(session("local[2]")).removeprefix("file://")
    assert os.path.isdir(own) and local_folder(session("local[2]"), "x") == f"{own}/x"
