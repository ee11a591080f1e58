"""The span join of the audit stream, one call per action."""

from __future__ import annotations

import pandas as pd

from mendgrid.streaming.audit import join_spans

BIG = 2**53 + 1


class State:
    def __init__(self, held=None):
        self.exists, self.get = held is not None, held

    def update(self, held):
        self.get = held


def span(batch, first, last):
    ends = {f"{e}_{c}": [v] for e, at in (("first", first), ("last", last)) for c, v in zip(("at", "id", "status"), at)}
    return pd.DataFrame({"action_id": [7], **ends, "batch_id": [batch]})


def test_span_that_changes_nothing_makes_no_frame():
    state = State(("2025-01-01", 1, "Open"))
    same = span(2, ("2025-01-02", 2, "Open"), ("2025-01-03", 3, "Failed"))
    assert list(join_spans((7,), iter([same]), state)) == [] and state.get == ("2025-01-03", 3, "Failed")


def test_spans_of_several_frames_keep_their_order_and_large_ids():
    state = State()
    empty = span(3, (None, None, None), (None, None, None))
    second, first = (
        span(2, ("2025-01-03", BIG + 2, "Failed"), ("2025-01-04", BIG + 4, "Open")),
        span(1, ("2025-01-01", BIG, "Open"), ("2025-01-02", BIG + 2, "Pending")),
    )
    (made,) = join_spans((7,), iter([second, empty.iloc[:0], first]), state)
    changes = made[["span_batch", "event_id", "old_status", "new_status"]].values.tolist()
    assert changes == [[1, BIG, None, "Open"], [2, BIG + 2, "Pending", "Failed"]]
    assert state.get == ("2025-01-04", BIG + 4, "Open")
    (late,) = join_spans((7,), iter([span(4, ("2025-01-01", BIG, "Open"), ("2025-01-01", BIG, "Open"))]), State(state.get))
    assert late[["span_batch", "event_id", "held_at", "held_id"]].values.tolist() == [[4, None, "2025-01-04", BIG + 4]]
