import sys

from wardcast.llm import queries, token_trees


def test_counts_that_are_kept_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(token_trees, "MOST_KNOWN", 20_000)
    known = token_trees.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    fresh = token_trees.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    pieces = [f"word{i}" for i in range(1000)] + ["long" * 10_000] + [f"word{i}" for i in range(50)]
    for piece in pieces:
        assert known.count(piece) == len(fresh._encode(piece))
        assert sum(sys.getsizeof(p) for p in known._known) <= 20_000
    assert "word49" in known._known and "long" * 10_000 not in known._known
