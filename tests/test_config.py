import json
from datetime import date

import pytest

from tidemark import config


def test_layers(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"embargo": 10, "every": 3, "band": 5}))
    c = config.load(str(path), {"every": 9, "out_dir": None}, {"TIDEMARK_EMBARGO": "11"})
    assert (c.embargo, c.every, c.band, c.min_train, c.out_dir) == (11, 9, 5.0, 312, "out")
    with pytest.raises(ValueError, match="unknown"):
        config.load(None, {"nope": 1}, {})


def test_words():
    assert config.weeks("312w") == 312 and config.as_of("2024-07-05") == date(2024, 7, 5)
    with pytest.raises(ValueError):
        config.weeks("312")


def test_weekly_records(spark):
    from tidemark.catalog import QUERIES

    import __spark_entry__  # noqa: F401

    rows = QUERIES["weekly_output"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["distribution"]["q05"] <= r["distribution"]["q50"] <= r["distribution"]["q95"] for r in rows)
    assert all(r["decision"]["offense_final"] == 50 for r in rows if r["mode"] != "NORMAL")
