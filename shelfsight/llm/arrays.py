"""SQL snippets over arrays inside one row."""

from __future__ import annotations

BLOCK = 256


def block_folds(array: str, fold: str) -> str:
    """The fold of each run of BLOCK elements; ``fold`` combines s and t."""
    return (
        f"transform(sequence(0, greatest(size({array}) - 1, 0) div {BLOCK}), "
        f"b -> aggregate(slice({array}, b * {BLOCK} + 1, {BLOCK}), 0, (s, t) -> {fold}))"
    )


def running(array: str, blocks: str, i: str, fold: str) -> str:
    """The fold of elements 0 to ``i``, reading at most BLOCK elements and the blocks before. ``blocks`` is
    block_folds(array) as a column."""
    i = f"({i})"
    return (
        f"aggregate(slice({array}, ({i} div {BLOCK}) * {BLOCK} + 1, {i} % {BLOCK} + 1), "
        f"aggregate(slice({blocks}, 1, {i} div {BLOCK}), 0, (s, t) -> {fold}), (s, t) -> {fold})"
    )
