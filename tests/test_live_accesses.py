"""State accesses of the live held flags: as many for a key with many buckets as for one with a few."""

import numpy as np
import pandas as pd

from welltide.streaming.live import HeldFlag, flip_after

HOUR = 3_600_000


class Handle:
    """Stands in for the state store and counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, v):
        self.calls.append("update")
        self.value = v

    def registerTimer(self, ms):
        self.calls.append("timer")


def test_many_buckets_take_no_more_accesses_than_one():
    rng = np.random.default_rng(1)
    values = rng.choice([30.0, 50.0], (200, 3))
    f = pd.DataFrame({"end": [(i + 1) * HOUR for i in range(200)], "at": [np.arange(3) + i * HOUR * 1000 for i in range(200)], "value": list(values)})
    h = Handle()
    p = HeldFlag(40.0, 3, 24 * HOUR)
    p.init(h)
    out = pd.concat(p.handleInputRows(("w", "c"), iter([f.sample(frac=1, random_state=2)]), None))
    assert h.calls == ["get", "update", "timer"]
    assert out["held"].tolist() == flip_after(values.ravel() >= 40.0, None, 0, 3)[0].tolist()
    # A day and an hour later the flag is forgotten, an hour earlier it is not.
    for wait, held in ((24, bool(out["held"].iloc[-1])), (25, not out["held"].iloc[-1])):
        h.value = (bool(out["held"].iloc[-1]), 0, 200 * HOUR)
        v = 30.0 if out["held"].iloc[-1] else 50.0
        g = pd.DataFrame({"end": [(200 + wait) * HOUR], "at": [np.array([0])], "value": [np.array([v])]})
        assert pd.concat(p.handleInputRows(("w", "c"), iter([g]), None))["held"].tolist() == [held]
