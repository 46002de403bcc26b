"""T-occurrence search where the largest component changes while sets are put off."""
import random

import numpy as np

from vecloom.llm import jaccard_join

from .cases import components


class Linked(jaccard_join.Search):
    """The search's order and bookkeeping over links that are given."""

    def __init__(self, n: int, links: set[tuple[int, int]]):
        self.comp, self.members = np.arange(n), {i: [i] for i in range(n)}
        self.weight, self.indexed_for, self.links = -np.arange(n, dtype=float), 0, links

    def matches(self, x: int) -> list[int]:
        return [y for y in range(len(self.comp)) if (min(x, y), max(x, y)) in self.links and self.comp[x] != self.comp[y]]


def test_links_are_found_whichever_component_is_largest():
    for seed in range(400):
        rng = random.Random(seed)
        n = rng.randrange(8, 40)
        links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(n // 2, n + 4))}
        got = Linked(n, links).run()
        want = components({i: {i, *[n + k for k, e in enumerate(sorted(links)) if i in e]} for i in range(n)}, 0)  # sets that share an element link
        assert len({*zip(got.tolist(), (want[i] for i in range(n)))}) == len(set(got.tolist())) == len(set(want.values())), seed


def test_sets_put_off_in_what_is_no_longer_largest_are_looked_up():
    """c2, a2 and b2 are put off in turn; C is largest when c2's turn comes again, A and B together when b2's does."""
    c1, c2, a1, a2, a3, b1, b2, b3, b4, c3, c4, c5 = range(12)
    links = {(c1, c2), (a1, a2), (a1, a3), (b1, b2), (b1, b3), (b1, b4), (c2, c3), (c3, c4), (c3, c5), (a2, b2), (c2, b2)}
    assert len(set(Linked(12, links).run().tolist())) == 1
