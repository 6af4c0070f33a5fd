"""A bulk-loaded R-tree over boxes in numpy (sort-tile-recursive packing, Leutenegger et al. 1997)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16


class RTree:
    """Boxes are rows (x0, y0, x1, y1), ends included.  An empty tree finds nothing."""

    def __init__(self, boxes: np.ndarray):
        boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
        n = len(boxes)
        slices = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
        by_x = np.argsort(boxes[:, 0] + boxes[:, 2], kind="stable")
        slab = np.empty(n, dtype=np.int64)
        slab[by_x] = np.arange(n) // max(1, int(np.ceil(n / slices)))
        self.order = np.lexsort((boxes[:, 1] + boxes[:, 3], slab))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > FANOUT:
            low = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append(np.column_stack([np.minimum.reduceat(low[:, :2], starts), np.maximum.reduceat(low[:, 2:], starts)]))

    def probe(self, boxes: np.ndarray, aim: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe numbers, box numbers) of all intersections, block by block.

        As many probes make a block as, by the hits of the block before, find about ``aim`` boxes.
        """
        boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
        if not len(self.order):
            return
        at, block = 0, 64
        while at < len(boxes):
            q = boxes[at : at + block]
            top = self.levels[-1]
            who, node = np.repeat(np.arange(len(q)), len(top)), np.tile(np.arange(len(top)), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                b, w = self.levels[depth][node], q[who]
                hit = (b[:, 0] <= w[:, 2]) & (b[:, 2] >= w[:, 0]) & (b[:, 1] <= w[:, 3]) & (b[:, 3] >= w[:, 1])
                who, node = who[hit], node[hit]
                if depth:
                    below = len(self.levels[depth - 1])
                    who = np.repeat(who, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    who, node = who[node < below], node[node < below]
            yield who + at, self.order[node]
            at += len(q)
            block = int(min(4096, max(1, aim // max(1, len(who) // len(q))), 8 * block))
