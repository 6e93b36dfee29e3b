"""Uniqueness on streams: many values at a time, and a value too large for memory."""

import pandas as pd

from gridcheck.streaming import unique as U
from gridcheck.violations import row_key


class State:
    """A value's state outside Spark."""

    def __init__(self, known=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.removed, self.timeout = known, known is not None, timed_out, False, None

    def update(self, value):
        self.get = value

    def remove(self):
        self.removed = True

    def getCurrentWatermarkMs(self):
        return 5

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def chunk(*rows):
    return pd.DataFrame(rows, columns=["row_key", "value", "us"])


def test_values_pass_to_python_many_at_a_time(spark, tmp_path):
    spark.createDataFrame([], "id long, v string, ts timestamp").write.parquet(str(tmp_path / "in"))
    found = U.stream_check_unique(spark.readStream.schema("id long, v string, ts timestamp").parquet(str(tmp_path / "in")), "t", "v", row_key("id"), "ts", "1 hour")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_rows_of_a_value_wait_until_its_first_is_known(monkeypatch):
    monkeypatch.setattr(U, "WAITING", 64)  # so that they go to disk
    state = State()
    rows = [chunk(*((f"k{i}", "V", 9_000_000) for i in range(1000))), chunk(("a", "v", 2_000_000), ("b", "v", 2_000_000), ("a", "v", 2_000_000)), chunk(("z", "v", 3_000_000))]
    found = pd.concat(U._repeats(("v",), iter(rows), state))
    # the first comes in the second chunk; its copy is a repeat
    assert set(found["first"]) == {"a"} and found.row_key.tolist() == [f"k{i}" for i in range(1000)] + ["b", "a", "z"] and found.value.tolist() == ["V"] * 1000 + ["v"] * 3
    assert state.get == ("a", 9001) and state.timeout == 9001


def test_a_known_first_stays(monkeypatch):
    state = State(("old", 9001))
    found = pd.concat(U._repeats(("v",), iter([chunk(("new", "v", 1_000), ("old", "v", 2_000))]), state))
    assert found.values.tolist() == [["old", "new", "v"], ["old", "old", "v"]] and state.get == ("old", 9001) and state.timeout == 9001
    late = State(("old", 3))
    list(U._repeats(("v",), iter([chunk(("new", "v", 1_000))]), late))
    assert late.timeout == 6  # behind the watermark
    gone = State(("old", 3), timed_out=True)
    assert list(U._repeats(("v",), iter([]), gone)) == [] and gone.removed
