"""Slow and plain versions for tests."""

from tidemill.llm import shingles as S


def kept_by_all_pairs(rows, k, percent):
    """Ids of the least document of each component."""
    sets = [S.shingle_set(t, k) for _, t in rows]
    pairs = S.linked_pairs(sets, None, percent)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(rows[a][0]), root(rows[b][0])
        parent[max(x, y)] = min(x, y)
    return sorted(d for d in parent if parent[d] == d)
