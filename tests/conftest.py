import pytest

from sluice.session import local_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8)
    shared_dir(session)
    return session


@pytest.fixture()
def folder(tmp_path_factory):
    """A new folder per test, left in place afterwards."""
    return str(tmp_path_factory.mktemp("dump"))


def write(folder: str, name: str, data: str | bytes) -> str:
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode("utf-8"))
    return path
