"""The sampler's parts: its table of pieces, and what tasks of one process share."""

import numpy as np

from stacksift.llm import pieces
from stacksift.llm.common import lean, tokenizer_path


def test_every_piece_is_found():
    """Walking down by characters finds each node, and nothing for characters that no piece has there."""
    s = pieces.PieceSampler(tokenizer_path("piece_bpe_32k.model"))
    keys = s.keys[s.keys >= 0]
    assert len(keys) == len(s.piece) - 1 and sorted(s._next(keys)) == list(range(1, len(s.piece)))
    other = np.setdiff1d(np.arange(100_000) << pieces.CHAR | 0x10FFFF, keys)
    assert (s._next(other) == -1).all()


def test_pieces_are_read_once_in_a_process():
    """Later tasks begin without states or edges, and give equal ids; room is kept, so it isn't filled anew."""
    path = tokenizer_path("piece_bpe_32k.model")
    s = pieces.sampler(path, 1.0, 0)
    first = s.encode(["some words, and some more"], [3])[0]
    s.forget()
    assert pieces.sampler(path, 1.0, 0) is s and not s.base and not s.arrays[0].n
    assert (s.encode(["some words, and some more"], [3])[0] == first).all()
    room = s.arrays[0].room
    s._reset()
    assert s.arrays[0].room is room and not s.arrays[0].n


def test_lean(monkeypatch):
    """Memory is given back after the last batch, and when a batch fails."""
    from stacksift.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(lean(iter)([1, 2])) == [1, 2] and calls == [1]

    def fails(batches):
        yield next(batches)
        raise ValueError

    out = lean(fails)(iter([1]))
    next(out)
    try:
        next(out)
    except ValueError:
        calls.append(2)
    assert calls == [1, 1, 2]
