"""First sightings keep the keys of a group as one table."""

import pandas as pd

from corpusloom.streaming import first_seen


class Handle:
    """The calls that a processor makes to its state."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_many_keys_take_few_calls():
    """Before, each key of a batch read and wrote a state of its own."""
    handle, processor = Handle(), first_seen.FirstSightings()
    processor.init(handle)
    rows = lambda keys, at, rank: pd.DataFrame({"watch_topic_id": "a", "paper_id": keys, "rank_score": rank, "seen_us": at})
    keys = [f"p{i}" for i in range(500)]
    list(processor.handleInputRows((0,), iter([rows(keys, 5_000_000, 0.5), rows(keys[:3], 5_000_000, 0.9)]), None))
    list(processor.handleInputRows((0,), iter([rows(keys[:10], 2_000_000, 0.1), rows(["late"], 9_000_000, 0.2)]), None))
    assert handle.calls == 3 and handle.timers == {2001}
    handle.timers.clear()
    told = pd.concat(processor.handleExpiredTimer((0,), At(6000), At(2001)))
    assert len(told) == 500 and set(told.loc[told["first_us"] == 2_000_000, "rank_score"]) == {0.1} and handle.timers == {9001}
    list(processor.handleInputRows((0,), iter([rows(keys, 1_000_000, 0.7)]), None))  # told once
    again = pd.concat(processor.handleExpiredTimer((0,), At(9002), At(9001)))
    assert list(again["paper_id"]) == ["late"]
