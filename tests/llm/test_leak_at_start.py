"""Items whose beginning a text lacks."""

import random

import pytest
from test_operators import semi_global, words


@pytest.mark.parametrize("seed", range(4))
def test_text_starts_within_an_item(seed):
    from graphloom.llm.decontaminate import Matcher, budget, normal

    rng = random.Random(seed)
    item = normal(words(rng, 40))
    k = budget(len(item))
    matcher = Matcher([(1, item)])
    assert k >= 3
    for lacking in range(k + 2):
        text = item[lacking:] + " " + words(rng, 8)
        want = semi_global(item, normal(text))
        assert [h[3] for h in matcher.find(text)] == ([want] if want <= k else []), lacking
    first, _, rest = item.partition(" ")
    assert [h[3] for h in matcher.find(first[:-1] + " " + rest)] == [1]
