import random

from docweave.operators import hierarchy


def brute(parents):
    """node -> (root, depth, fault) by walking up."""
    out = {}
    for node in parents:
        seen, at = [node], node
        while True:
            up = parents[at]
            if up is None or up not in parents:
                out[node] = (at, len(seen) - 1, "orphan" if parents[node] is not None and parents[node] not in parents else None)
                break
            if up in seen:
                cycle = seen[seen.index(up) :]
                out[node] = (None, None, "cycle" if node in cycle else "below_cycle")
                break
            seen.append(up)
            at = up
    return out


def rows(spark, parents):
    data = [("d", k, v, 1) for k, v in parents.items()]
    return spark.createDataFrame(data, "document_id string, unit_id string, parent_id string, loaded_at int")


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    for size in (1, 7, 60):
        names = [f"u{i}" for i in range(size)]
        parents = {n: rng.choice([None, "gone", *names]) for n in names}
        want = brute(parents)
        got = {r.node: r for r in hierarchy.resolve(hierarchy.nodes(rows(spark, parents))).collect()}
        faults = {r.node: r.fault for r in hierarchy.faults(hierarchy.nodes(rows(spark, parents))).collect()}
        assert set(got) == set(parents)
        for n, (root, depth, fault) in want.items():
            assert (got[n].root, got[n].depth) == (root, depth)
            assert faults.get(n) == fault
            if root:
                assert len(got[n].path) == depth + 1 and got[n].path[0] == root and got[n].path[-1] == n


def test_deep_chain_nulls_repeats_and_clashing_columns(spark):
    parents = {f"u{i}": f"u{i - 1}" if i else None for i in range(300)}
    data = [("d", k, v, 1, "x", 0) for k, v in parents.items()] * 2 + [(None, "a", None, 1, "x", 0), ("d", None, "u1", 1, "x", 0)]
    df = spark.createDataFrame(data, "document_id string, unit_id string, parent_id string, loaded_at int, root string, depth int")
    got = {r.node: r.depth for r in hierarchy.resolve(hierarchy.nodes(df)).collect()}
    assert got == {f"u{i}": i for i in range(300)}


def test_empty_and_descendants(spark):
    empty = rows(spark, {"a": None}).limit(0)
    assert hierarchy.resolve(hierarchy.nodes(empty)).count() == 0
    assert hierarchy.faults(hierarchy.nodes(empty)).count() == 0
    pairs = hierarchy.descendants(hierarchy.resolve(hierarchy.nodes(rows(spark, {"a": None, "b": "a", "c": "b"}))))
    assert {(r.ancestor, r.descendant, r.distance) for r in pairs.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
