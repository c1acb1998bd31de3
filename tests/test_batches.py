"""What goes through batches: results don't depend on where they are cut, and few rows are held."""

import random

import pyarrow as pa

from chronotext.functions import sounds
from chronotext.operators import folds, readings


def test_families_over_batches():
    dice, rows = random.Random(6), []
    for key in range(40):
        at = 0
        for place in range(dice.randrange(60)):
            at += dice.choice([1, 4, 8, 15, 16])
            rows.append((key, place, at, dice.choice([1, 1, 1, 2])))
    want, joined, own = [], [], None
    for before, r in zip([None, *rows], rows):
        same = before is not None and before[0] == r[0]
        joined.append(same and before[3] == r[3] and r[2] - before[2] <= sounds.ONE_SOUND)
        if not (same and own[3] == r[3] and r[2] - own[2] <= sounds.ONE_SOUND):
            want.append(r)
            own = r
    columns = dict(zip(("key", "place", "at", "family"), map(list, zip(*rows)))) | {"joined": joined}
    for size in (1, 3, 7, 10_000):
        got = folds._heard(iter(pa.table(columns).to_batches(max_chunksize=size)))
        assert [tuple(x.values()) for b in got for x in b.to_pylist()] == want


def test_readings_in_little_memory(spark):
    import tracemalloc

    line, theirs = pa.array(["{山水|やまみず}と{火木|ひき}は" * 4] * 6000), pa.array(["やまみずときひは" * 4] * 6000)
    own = readings.columns()
    tracemalloc.start()
    (got,) = list(own["differences"].func(iter([(line, theirs)])))
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    assert len(got) == 6000 and [d["theirs"] for d in got[0].as_py()] == [d["theirs"] for d in readings.differences(line[0].as_py(), theirs[0].as_py())] != []
