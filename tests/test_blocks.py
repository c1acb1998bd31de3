"""Blocks and pairings of long texts: the same as line by line, in far less time."""

import random
import time

import pytest

from chronotext.operators import alignment


def text(dice, n):
    return "".join(dice.choices(["th", "an", "in", "er", "on", "re", "ti", "es"], k=n // 2))


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_blocks_line_by_line(monkeypatch, bound):
    monkeypatch.setattr(alignment, "PAIRS", bound)  # beyond it a block is looked for line by line
    dice = random.Random(8)
    for _ in range(150):
        a, b = text(dice, 120), text(dice, 200)
        b = b[:50] + a[20:70] + b[50:]
        x, y = alignment._codes(a, b)
        out, todo = [], [(0, len(x), 0, len(y))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            if a0 < a1 and b0 < b1:
                i, j, k = alignment._longest_block(x[a0:a1], y[b0:b1])
                if k:
                    out.append((a0 + i, b0 + j, k))
                    todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + k, a1, b0 + j + k, b1)]
        assert alignment.matching_blocks(a, b) == sorted(out)
        assert alignment.matching_blocks(a, b, 2) == [z for z in sorted(out) if z[2] > 1]
        share = sum(z[2] for z in out) / len(a)
        for enough in (0.3, 0.5, 0.7):
            got = alignment.covered_in_order(a, b, enough)
            assert got == share if share < enough else got >= enough


def test_many_heard_lines_in_time():
    dice = random.Random(9)
    song, heard = text(dice, 3000), [text(dice, 300) for _ in range(40)]
    began = time.process_time()
    for x in heard:
        alignment.uncovered_stretches(x, song, 6)
        alignment.pairs_in_order(x, song)
    assert time.process_time() - began < 2.5


def test_lines_at_the_cursor_without_sorting(monkeypatch):
    from chronotext.operators import locating

    dice = random.Random(10)
    song = text(dice, 4000)
    near = locating.Occurrences(song)
    assert [near.find(song[k : k + 40], k) for k in range(0, 3900, 40)] == list(range(0, 3900, 40)) and not near._sorted
    monkeypatch.setattr(locating, "WALKS", 0)
    sorted_ones = locating.Occurrences(song)
    for _ in range(300):
        k, n, since = dice.randrange(3900), dice.randrange(2, 30), dice.randrange(4000)
        line = song[k : k + n] if dice.random() < 0.8 else text(dice, 12)
        assert locating.Occurrences.find(near, line, since) == sorted_ones.find(line, since) == song.find(line, since)
