"""Cuts that come again are not encoded again."""

from poolwright.llm.tokens import _Cuts


def test_as_many_cuts_are_remembered_as_a_task_meets_often():
    calls = []
    cuts = _Cuts(lambda s: calls.append(s) or [len(s), 50_000], " ")
    for _ in range(2):
        for k in range(140_000):
            assert cuts[f"w{k}"] == (len(f" w{k}")).to_bytes(4, "little") + (50_000).to_bytes(4, "little")
    assert len(calls) == 140_000
