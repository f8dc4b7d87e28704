from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from buildlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def put(tmp_path):
    """Write files below a run folder and return the folder."""

    def write(files: dict[str, str], run: str = "run1") -> str:
        folder = tmp_path / run
        folder.mkdir(exist_ok=True)
        for name, text in files.items():
            (folder / name).write_bytes(text.encode("utf-8"))
        return str(folder)

    return write


def rows(df, *columns):
    return sorted(
        (tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((v is None, str(v)) for v in t)
    )
