"""A ball tree over one shard of integer vectors, searched by branch and bound."""

from __future__ import annotations

import numpy as np

LEAF = 64
LOWEST = np.iinfo(np.int64).min


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered float rows, as int64; products
    beyond 64 bits are held at the ends of the range."""
    if not left.shape[1]:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if top < 2**53:
        return (left @ right.T).astype(np.int64)
    if top < 2**62:
        return left.astype(np.int64) @ right.T.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(left).dot(whole(right).T)
    ends = np.iinfo(np.int64)
    return np.vectorize(lambda x: min(max(x, ends.min), ends.max), otypes=[np.int64])(exact)


class BallTree:
    """Nodes in preorder: [start, end, left, right] over the reordered vectors, centre
    and radius; leaves have no children (-1)."""

    def __init__(self, ids, vectors, nodes, centers, radii):
        self.ids, self.vectors, self.nodes = ids, vectors, nodes
        self.centers, self.radii = centers, radii

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> BallTree:
        order = np.argsort(ids, kind="stable")
        nodes: list[list[int]] = []
        centers, radii = [], []
        waiting = [(0, len(ids), -1, 2)]
        while waiting:
            start, end, parent, side = waiting.pop()
            here, number = vectors[order[start:end]], len(nodes)
            center = here.mean(axis=0)
            reach = np.sqrt(((here - center) ** 2).sum(axis=1))
            nodes.append([start, end, -1, -1])
            centers.append(center)
            radii.append(float(reach.max()))
            if parent >= 0:
                nodes[parent][side] = number
            if end - start > LEAF and reach.max() > 0:
                far = here[int(reach.argmax())]
                axis = far - here[int(((here - far) ** 2).sum(axis=1).argmax())]
                split = np.argsort(here @ axis, kind="stable")
                order[start:end] = order[start:end][split]
                middle = (start + end) // 2
                waiting += [(middle, end, number, 3), (start, middle, number, 2)]
        return cls(
            ids[order], vectors[order], np.array(nodes, dtype=np.int64), np.array(centers), np.array(radii)
        )

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """(scores, ids) of the k best per query, (LOWEST, max) where fewer; ``least``
        is a score that k candidates are known to reach, and nothing below it is found.

        All queries go down together; a node is left by those whose upper bound of
        the inner product is below their current kth score."""
        n = len(queries)
        scores = np.full((n, k), LOWEST, dtype=np.int64)
        found = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        kth = least.astype(np.float64)
        norms = np.sqrt((queries**2).sum(axis=1))
        bound = queries @ self.centers.T + norms[:, None] * self.radii[None, :]
        bound += 1e-9 * (1 + np.abs(bound) + norms[:, None] * np.abs(self.radii)[None, :])
        waiting = [(0, np.arange(n))]
        while waiting:
            node, active = waiting.pop()
            active = active[bound[active, node] >= kth[active]]
            if not len(active):
                continue
            start, end, left, right = self.nodes[node].tolist()
            if left >= 0:
                near, far = left, right
                if bound[active, right].mean() > bound[active, left].mean():
                    near, far = right, left
                waiting += [(far, active), (near, active)]
                continue
            products = inner_products(queries[active], self.vectors[start:end])
            ids = self.ids[start:end]
            allowed = (ids[None, :] != query_ids[active, None]) & (products >= kth[active, None])
            some = allowed.any(axis=1)
            if not some.any():
                continue
            active, products, allowed = active[some], products[some], allowed[some]
            all_scores = np.concatenate([scores[active], np.where(allowed, products, LOWEST)], axis=1)
            all_ids = np.concatenate(
                [found[active], np.where(allowed, ids[None, :], np.iinfo(np.int64).max)], axis=1
            )
            # ~score sorts falling without leaving the range of int64
            best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[active] = np.take_along_axis(all_scores, best, axis=1)
            found[active] = np.take_along_axis(all_ids, best, axis=1)
            full = found[active, k - 1] != np.iinfo(np.int64).max
            kth[active[full]] = np.maximum(kth[active[full]], scores[active[full], k - 1])
        return scores, found
