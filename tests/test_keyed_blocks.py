"""State is touched per block, not per event, and holds the same events as a plain trim of everything that arrived."""

from __future__ import annotations

import random

from pyspark.sql import Row

from asofkit.definitions import STANDARD
from asofkit.streaming.keyed import ItemState, UserState


class Variable:
    """A state variable of one key that counts the calls which would go to the JVM."""

    def __init__(self):
        self.entries, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"_{name}")(*args)

        return call

    def _exists(self):
        return bool(self.entries)

    def _get(self):
        found = self.entries.get(())
        return iter(found) if isinstance(found, list) else iter(()) if found is None and self.listed else found

    def _update(self, value):
        self.entries[()] = value

    _put = _update

    def _keys(self):
        return iter(list(self.entries))

    def _iterator(self):
        return iter(list(self.entries.items()))

    def _containsKey(self, key):
        return key in self.entries

    def _getValue(self, key):
        return self.entries.get(key)

    def _updateValue(self, key, value):
        self.entries[key] = value

    def _removeKey(self, key):
        self.entries.pop(key, None)


class Handle:
    def __init__(self):
        self.made = {}

    def _make(self, name, listed=False):
        self.made[name] = Variable()
        self.made[name].listed = listed
        return self.made[name]

    def getMapState(self, name, *_):
        return self._make(name)

    getValueState = getMapState

    def getListState(self, name, *_):
        return self._make(name, True)

    def calls(self):
        return sum(v.calls for v in self.made.values())


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def fed(processor, entries):
    rows = [Row(**dict(zip(processor.names, e, strict=True))) for e in entries]
    (counts,) = processor.handleInputRows((1,), iter(rows), None)
    return counts


def held(variable):
    return {e for block in variable.entries.values() for e in zip(*block, strict=True)}


def user_entries(rng, n):
    span = 6 * STANDARD.user_retention_ms
    return [(rng.randrange(-span, span), rng.randrange(3), rng.choice(("view", "addtocart")), None if rng.random() < 0.8 else rng.randrange(2)) for _ in range(n)]


def test_a_batch_of_many_events_makes_few_calls():
    retention = STANDARD.user_retention_ms
    user = UserState()
    handle = started(user)
    fed(user, [(t * (retention // 400), t, "view", None) for t in range(400)])
    assert handle.calls() < 12
    item = ItemState()
    handle = started(item)
    retention = STANDARD.item_retention_ms
    entries = [(t * (retention // 2000), t, None) for t in range(2000)]
    assert fed(item, entries).kept == 2000
    assert handle.calls() < 60
    assert fed(item, entries).repeated == 2000
    # events before the window of the last one need no look-up at all
    before = handle.calls()
    assert fed(item, [(-retention - t, t, None) for t in range(1, 2000)]).dropped == 1999
    assert handle.calls() - before < 4


def test_users_hold_what_a_plain_trim_of_all_arrivals_holds():
    for seed in range(20):
        rng = random.Random(seed)
        user = UserState(length=7)
        handle = started(user)
        everything, kept = set(), set()
        for _ in range(6):
            batch = user_entries(rng, rng.randrange(1, 25)) + rng.sample(sorted(everything, key=str), min(3, len(everything)))
            counts = fed(user, batch)
            arrived = set(batch)
            everything |= arrived
            now = user.trimmed(kept | arrived)
            assert counts.repeated == len(arrived & kept) and counts.kept == len(now - kept)
            kept = now
            assert held(handle.made["retained"]) == kept
            times = sorted(e[0] for e in kept)
            assert handle.made["span"].entries[()] == (times[-1], user.session_start(times))
            last = sorted(everything, key=lambda e: tuple((x is not None, x) for x in e))[-7:]
            (block,) = handle.made["tail"].entries[()]
            assert list(zip(*block, strict=True)) == last


def test_items_hold_the_window_before_their_last_event():
    retention = STANDARD.item_retention_ms
    for seed in range(20):
        rng = random.Random(seed)
        item = ItemState()
        handle = started(item)
        kept, last = set(), None
        for step in range(8):
            at = step * retention // 3
            batch = {(at + rng.randrange(-2 * retention, retention), rng.randrange(3), None) for _ in range(rng.randrange(1, 30))}
            batch |= set(rng.sample(sorted(kept, key=str), min(3, len(kept))))
            batch |= {(e[0] + rng.choice((-1, 0, 1)), 5, 6) for e in batch}
            counts = fed(item, sorted(batch, key=str))
            last = max([e[0] for e in batch] + ([] if last is None else [last]))
            now = {e for e in kept | batch if e[0] >= last - retention}
            assert counts.repeated == len(batch & kept) and counts.kept == len({e for e in batch - kept if e[0] >= last - retention})
            assert counts.dropped == len(batch - kept) - counts.kept + len(kept - now)
            kept = now
            assert held(handle.made["retained"]) == kept
