"""The map's groups against the rules played pair by pair, over a whole table."""

import pytest

from lorebase.operators import graph
from lorebase.plans import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return queries._edges(spark, D)


def plain(nodes, edges, sources):
    """{id: label}: labels that spread along edges, then the closest two groups joined."""
    ids = [n["id"] for n in nodes]
    near = {i: [] for i in ids}
    for e in edges:
        near[e["source"]].append((e["target"], e["weight"]))
        near[e["target"]].append((e["source"], e["weight"]))
    label = {i: i for i in ids}
    for _ in range(8):
        old = dict(label)
        for i in sorted(ids, key=lambda i: (-sum(w for _, w in near[i]), i)):
            votes = {}
            for j, w in near[i]:
                votes[label[j]] = votes.get(label[j], 0) + w
            label[i] = max(votes, key=lambda x: (votes[x], x)) if votes else label[i]
        if old == label:
            break
    at = {n["id"]: n for n in nodes}
    link = {}
    for e in edges:
        x = 1.35 * (1 + e["weight"]) if e["kind"] == "explicit" else 0.32 * e["weight"]
        for k in ((e["source"], e["target"]), (e["target"], e["source"])):
            link[k] = link.get(k, 0) + x
    tie = {(i, j): link.get((i, j), 0) + 0.07 * len(sources.get(i, set()) & sources.get(j, set())) + 0.18 * len(set(at[i]["terms"][:8]) & set(at[j]["terms"][:8])) for i in ids for j in ids if i != j}
    groups = {}
    for i in ids:
        groups.setdefault(label[i], []).append(i)
    groups = list(groups.items())
    while len(groups) > graph.group_target(len(ids)):
        best, pair = None, None
        for a, (_, x) in enumerate(groups):
            for b in range(a + 1, len(groups)):
                y = groups[b][1]
                close = sum(tie[i, j] for i in x for j in y) + 0.24 * bool({at[i]["entity_type"] for i in x} & {at[j]["entity_type"] for j in y}) + 0.06 * (len(x) == 1 or len(y) == 1)
                if best is None or round(close, 9) > best:
                    best, pair = round(close, 9), (a, b)
        a, b = pair
        if len(groups[a][1]) < len(groups[b][1]):
            a, b = b, a
        groups[a] = (groups[a][0], groups[a][1] + groups[b][1])
        del groups[b]
    return {i: name for name, members in groups for i in members}


@pytest.mark.parametrize("kept", ["true", "kind = 'inferred' AND weight > 0.4", "kind = 'explicit' AND weight > 1.08", "false"])
def test_groups_equal_the_rules_played_pair_by_pair(whole, kept):
    nodes, supports, edges = whole
    edges = edges.where(kept)
    sources = {}
    for r in supports.collect():
        sources.setdefault(r["entity_id"], set()).add(r["source_id"])
    got = graph.node_groups(nodes, edges, supports).collect()
    want = plain(nodes.orderBy("rank").collect(), edges.collect(), sources)
    assert {r["id"]: r["label"] for r in got} == want
    sizes = {}
    for r in got:
        sizes.setdefault(r["group"], set()).add(r["id"])
    assert [len(sizes[g]) for g in sorted(sizes)] == sorted(map(len, sizes.values()), reverse=True)
