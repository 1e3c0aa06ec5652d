"""Small graphs, and plain-Python versions of what the operators compute."""

import random

from tributary.plans.demo import plain_graph


def graph(spark, edges, nodes=()):
    ids = sorted({*nodes, *(x for e in edges for x in e)})
    return plain_graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(list(edges), "source string, target string"))


def random_edges(seed, n=12, m=18):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)} - {(f"n{i:02}", f"n{i:02}") for i in range(n)})


def reachable(edges):
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    found = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        found[s] = seen
    return found


def cycles(edges):
    r = reachable(edges)
    return {tuple(sorted(y for y in r if y in r[x] and x in r[y])) for x in r if any(y != x and x in r[y] for y in r[x])}


def components(nodes, edges):
    low = {n: n for n in nodes}
    for _ in nodes:
        for s, t in edges:
            low[s] = low[t] = min(low[s], low[t])
    return low


def bridges(nodes, edges):
    pairs = {tuple(sorted(e)) for e in edges}
    count = lambda ps: len(set(components(nodes, ps).values()))
    return {p for p in pairs if count(pairs - {p}) > count(pairs)}


def pagerank(nodes, edges, iterations=30, d=0.85, tol=1e-6):
    n = len(nodes)
    out = {x: [t for s, t in edges if s == x] for x in nodes}
    rank = {x: 1 / n for x in nodes}
    for _ in range(iterations):
        new = {x: (1 - d) / n + sum(d * rank[s] / len(out[s]) for s, t in edges if t == x) for x in nodes}
        change = max(abs(new[x] - rank[x]) for x in nodes)
        rank = {x: new[x] / sum(new.values()) for x in nodes}
        if change < tol:
            break
    return rank


def paths(nodes, edges):
    found = {}
    for s in nodes:
        dist, sigma, front, d = {s: 0}, {s: 1}, [s], 0
        while front:
            d += 1
            nxt = {}
            for x in front:
                for a, b in edges:
                    if a == x and b not in dist:
                        nxt[b] = nxt.get(b, 0) + sigma[x]
            for b, k in nxt.items():
                dist[b], sigma[b] = d, k
            front = list(nxt)
        found[s] = (dist, sigma)
    return found


def betweenness(nodes, edges):
    p = paths(nodes, edges)
    b = {
        v: sum(p[s][1][v] * p[v][1][t] / p[s][1][t] for s in nodes for t in nodes if len({s, t, v}) == 3 and t in p[s][0] and v in p[s][0] and t in p[v][0] and p[s][0][v] + p[v][0][t] == p[s][0][t])
        for v in nodes
    }
    top = max(b.values())
    return {v: x / top if top else 0.0 for v, x in b.items()}


def closeness(nodes, edges):
    p, out = paths(nodes, edges), {}
    for s in nodes:
        ds = [d for d in p[s][0].values() if d]
        out[s] = min(1.0, (len(ds) - 1) / sum(ds) * (len(nodes) - 1)) if len(ds) > 1 else 0.0
    return out
