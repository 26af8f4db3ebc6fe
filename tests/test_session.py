"""Where written tables go."""

import threading
from types import SimpleNamespace

import pytest

from martlens.session import once_per_session, shared_folder


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}"


def session_with(master, conf=None, folder=None):
    settings = SimpleNamespace(get=lambda key, default: conf or default)
    return SimpleNamespace(conf=settings, sparkContext=Context(master, folder))


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_the_cluster_names_the_folder(master):
    assert shared_folder(session_with(master, "hdfs://nn/shared/")) == "hdfs://nn/shared"


def test_a_folder_set_by_the_application_counts():
    assert shared_folder(session_with("yarn", folder="s3a://b/c")) == "s3a://b/c"


def test_a_cluster_without_one_gets_none():
    assert shared_folder(session_with("spark://master:7077")) is None


def test_a_local_session_makes_its_own_and_keeps_it():
    local = session_with("local[2]")
    first = shared_folder(local)
    assert first.startswith("file:") and "martlens-" in first
    assert shared_folder(local) == first


def test_once_per_session():
    class Session:
        pass

    one, two, made = Session(), Session(), []

    def make():
        made.append(len(made))
        return made[-1]

    assert [once_per_session(s, "k", make) for s in (one, one, two)] == [0, 0, 1]
    assert once_per_session(one, "other", make) == 2


def test_keys_are_made_side_by_side():
    """One key waits for another that a second thread makes meanwhile."""

    class Session:
        pass

    one, other_made = Session(), threading.Event()

    def first():
        assert other_made.wait(10)
        return "first"

    def second():
        other_made.set()
        return once_per_session(one, "inner", lambda: "second")

    found = []
    waiting = threading.Thread(target=lambda: found.append(once_per_session(one, "a", first)))
    waiting.start()
    assert once_per_session(one, "b", second) == "second"
    waiting.join(10)
    assert found == ["first"]
