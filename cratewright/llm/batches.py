"""Parts of a batch of texts, so that memory follows the size of texts and not their number."""

from __future__ import annotations

from collections.abc import Iterator

MOST_SIGNS = 400_000


def by_size(texts: list[str | None], most: int = MOST_SIGNS) -> Iterator[list[str | None]]:
    """Runs of whole texts of at most ``most`` signs together; a longer text stands alone."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t) if t else 0
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part
