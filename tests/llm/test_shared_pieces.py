"""The table of pieces outlives a task."""

import public_tokenizers

from tallycast.llm import tokens


def test_later_tasks_find_the_pieces_of_earlier_ones(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        kept = {"tokenizer": f.read()}
    first, n = tokens.shared_pieces(kept).encode([b"one two three", b"two one"])
    asked, encode = [], tokens.Pieces.ids_of
    monkeypatch.setattr(tokens.Pieces, "ids_of", lambda self, pieces: asked.extend(pieces) or encode(self, pieces))
    again, m = tokens.shared_pieces(kept).encode([b"one two three", b"two one"])
    assert (first == again).all() and (n == m).all() and not asked
