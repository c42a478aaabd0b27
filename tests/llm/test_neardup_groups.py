"""What is left of large groups: all near pairs between components, by rows that grow with the texts and not with the groups."""

import random

import numpy as np
import pytest

from vellum.llm import neardup


def sets_of(r, n, parents, edits):
    """Sets of near sizes that share most values with one of some parents."""
    made = [[r.getrandbits(64) for _ in range(60)] for _ in range(parents)]
    for i in range(n):
        one = list(made[i % parents])
        for at in r.sample(range(60), r.randrange(*edits)):
            one[at] = r.getrandbits(64)
        yield np.array(sorted(set(one[: r.randrange(50, 61)])), np.uint64)


def brute(sets, roots, similarity):
    bags = [set(x.tolist()) for x in sets]
    return {(i, j) for j in range(len(bags)) for i in range(j) if roots[i] != roots[j] and len(bags[i] & bags[j]) >= similarity * len(bags[i] | bags[j]) - 1e-9}


def joined_rows(spark, known):
    """Rows that the joins of all executions but the ``known`` first made."""
    store, n = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(known, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size()) if "Join" in node.name()):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    n += int(str(value.get()).replace(",", ""))
    return n, runs.size()


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("known", [0, 40])
def test_no_near_pair_is_lost(similarity, known):
    r = random.Random(3)
    sets = list(sets_of(r, 160, 3, (0, 14)))
    sets += sets[:5]
    roots = np.array([r.choice((-5, i)) for i in range(len(sets))])
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    common = np.sort(np.argsort(-n)[:known])
    entries = [neardup.prefixes(sets[i : i + 50], np.arange(len(sets))[i : i + 50], roots[i : i + 50], (values[common], n[common]), similarity) for i in range(0, len(sets), 50)]
    found = set(zip(*(x.tolist() for x in neardup.meetings(np.concatenate(entries), similarity))))
    near = brute(sets, roots, similarity)
    assert near <= found and all(i < j and roots[i] != roots[j] for i, j in found)
    assert near


def test_rows_follow_the_texts(spark):
    """Texts that are in several large groups, and hardly near to each other."""
    r = random.Random(4)
    sets = list(sets_of(r, 900, 2, (8, 14)))
    for i in range(0, 60, 3):
        sets[i + 1] = np.sort(np.append(sets[i][1:], np.uint64(r.getrandbits(64))))
    roots = [i % 30 if i % 3 else 1000 + i for i in range(len(sets))]
    rows = spark.createDataFrame([(key, i, root) for key in range(8) for i, root in enumerate(roots)], "key long, near_a long, root long")
    kept = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "near_a long, near_set binary")
    _, known = joined_rows(spark, 0)
    found = {tuple(sorted(x)) for x in neardup.across(rows, kept, 0.8).collect()}
    joined, _ = joined_rows(spark, known)
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for i, j in found:
        top[max(find(i), find(j))] = min(find(i), find(j))
    near = brute(sets, roots, 0.8)
    assert near and all(find(roots[i]) == find(roots[j]) for i, j in near)
    assert found <= {tuple(sorted((roots[i], roots[j]))) for i, j in near}
    assert joined <= 4 * len(sets)
