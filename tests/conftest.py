import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom import session as session_helpers  # noqa: E402
from sensorloom.session import CHECKPOINT_SETTING, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "sensorloom-tests",
        cpus=4,
        partitions=4,
        settings={CHECKPOINT_SETTING: str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as if its master were one of a cluster, with no folder tried yet."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session_helpers, "_tried", set(), raising=False)
    return spark
