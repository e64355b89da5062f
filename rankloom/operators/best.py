"""The best rows of each of many queries, kept while a task goes through its rows."""

from __future__ import annotations

import numpy as np


class Best:
    """Of each query (a number from 0) the k best rows offered so far: by score, then the smaller place, then the smaller id.

    ``bound`` has the score of each query's last row once it has k: what scores less can be left out.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.bound = k, np.full(queries, -np.inf)
        self.rows: tuple[np.ndarray, ...] | None = None

    def offer(self, query: np.ndarray, score: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        new = (query, score, place, ids)
        query, score, place, ids = new if self.rows is None else (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, place, -score, query))
        sorted_query = query[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        kept = order[nth < self.k]
        self.rows = query[kept], score[kept], place[kept], ids[kept]
        last = order[nth == self.k - 1]
        self.bound[query[last]] = score[last]
