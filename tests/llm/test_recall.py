"""Recall of decontamination up to its tolerance, and of items that lie over one another."""

from __future__ import annotations

import random

import pytest

from overgrid.llm import decontaminate
from tests.llm import brute


def edited(item: list[str], edits: int, mixed: bool, some: random.Random) -> list[str]:
    """The item with so many words substituted or, if mixed, also put in or left out."""
    out = list(item)
    for at in sorted(some.sample(range(len(item)), edits), reverse=True):
        kind = some.choice("sid") if mixed else "s"
        out[at : at + (kind != "i")] = [] if kind == "d" else [f"x{some.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("percent", [10, 15, 20])
@pytest.mark.parametrize("mixed", [False, True])
def test_recall_up_to_the_tolerance(percent, mixed):
    some = random.Random(percent + mixed)
    items = [[f"w{some.randrange(10**6)}" for _ in range(some.randrange(20, 61))] for _ in range(250)]
    built = decontaminate.Items.build(list(range(len(items))), [" ".join(i) for i in items])
    around = lambda: [f"v{some.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([*around(), *edited(item, len(item) * percent // 100, mixed, some), *around()]) for item in items]
    found = {(t, i) for t, i, *_ in built.leaks(texts)}
    assert found <= {(k, k) for k in range(len(items))} and len(found) >= 249


def test_items_over_one_passage_are_all_found():
    some = random.Random(8)
    items, texts = [], []
    for _ in range(60):
        item = [f"w{some.randrange(10**6)}" for _ in range(40)]
        # The document holds the first item as it is; the second is a variant of it, the third lies within it.
        items += [item, edited(item, 8, False, some), edited(item[5:35], 6, False, some)]
        texts.append(" ".join(["a b c", *item, "d e f"]))
    built = decontaminate.Items.build(list(range(len(items))), [" ".join(i) for i in items])
    want = {(t, 3 * t + k) for t in range(len(texts)) for k in range(3)}
    assert all(brute.least_edits(items[i], texts[t].split()) <= len(items[i]) // 5 for t, i in want)
    got = {(t, i) for t, i, *_ in built.leaks(texts)}
    assert got <= want and len(got) >= len(want) - 1
