"""Where stored tables go."""

import pytest

from vacantia.session import shared_path


class Context:
    def __init__(self, master):
        self.master = master


class Session:
    """The two things ``shared_path`` asks a session for."""

    def __init__(self, folder, master):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, Context(master)


def test_named_folder_is_used():
    path = shared_path(Session("hdfs://shared/x/", "yarn"), "t")
    assert path.startswith("hdfs://shared/x/vacantia/t-")
    assert path != shared_path(Session("hdfs://shared/x/", "yarn"), "t")


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_path(Session(None, "spark://host:7077"), "t")


def test_local_session_may_use_its_own_folder():
    first, second = (shared_path(Session(None, "local[2]"), "t") for _ in range(2))
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
