import pytest


@pytest.fixture(scope="session")
def brute_groups():
    """Groups of rows from pairs of alike rows, by union-find: {row: smallest row of its group}."""

    def groups(rows, pairs):
        parent = {r: r for r in rows}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
        return {r: find(r) for r in rows}

    return groups
