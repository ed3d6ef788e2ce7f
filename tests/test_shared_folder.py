import tempfile

import pytest
from conftest import SF

from isogrid.plans import queries


@pytest.mark.parametrize("name", ["csv_scan", "shapefile_roundtrip", "geotiff_roundtrip", "archive_roundtrip"])
def test_files_go_below_the_shared_folder(spark, tmp_path, monkeypatch, name):
    def local(*_, **__):
        raise AssertionError("a machine-local folder was used")

    kind = type(spark.conf)
    get = kind.get
    # a core setting, which a running session can't change
    monkeypatch.setattr(kind, "get", lambda self, key, *more: f"file://{tmp_path}" if key == "spark.checkpoint.dir" else get(self, key, *more))
    monkeypatch.setattr(tempfile, "mkdtemp", local)
    assert queries.QUERIES[name](spark, SF).count() > 0
    assert list(tmp_path.iterdir())
