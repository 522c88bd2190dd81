"""Work folders: refused where they aren't shared, gone after ``clear``."""

from pathlib import Path

import cases
import pytest

from tidewatch.llm import common, mixing, simhash


class Context:
    master, applicationId = "spark://host:7077", "app"

    def getCheckpointDir(self):
        return None


class Session:
    sparkContext = Context()
    conf = {}


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session(), "x")


def test_nothing_is_left(spark):
    docs = cases.documents(spark)
    base = Path(common.scratch(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in base.iterdir()} if base.exists() else set()
    simhash.near_duplicates(docs).collect()
    mixing.mix(docs).collect()
    made = {p.name for p in base.iterdir()} - before
    common.clear(spark)
    assert made and not made & {p.name for p in base.iterdir()}
