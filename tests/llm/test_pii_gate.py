"""The gate before the labelers passes all that they find."""

import pytest


@pytest.mark.parametrize("text", ["jane at example (dot) com", "jane at example[dot]com", "jane at example {Dot} com", "JANE AT EXAMPLE DOT COM", "jane (At) example.com", "jane[aT]example.com", "jane At example dot com"])
def test_a_far_digit_changes_nothing(text):
    from graphloom.llm.pii import candidates

    alone = candidates(text + " x" * 100)
    assert [(c.kind, c.start, c.end) for c in alone] == [("email", 0, len(text))]
    assert alone == candidates(text + " x" * 100 + " 7")


@pytest.mark.parametrize("text", ["we met at noon", "LOOK AT EXAMPLE.COM NOW", "look At example.com", "look at example.com now", "a dot is here"])
def test_other_texts_are_judged_alike(text):
    from graphloom.llm.pii import candidates

    assert candidates(text) == candidates(text + " x" * 100 + " 7")
