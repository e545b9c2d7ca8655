"""What the exact search sends, and that it stays exact when most pairs are pruned."""

import logging
import re

import numpy as np
import pytest

from reportloom.llm import vector_search


def asked(spark, vectors, caplog, **options):
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    with caplog.at_level(logging.INFO, logger=vector_search.__name__):
        got = sorted(map(tuple, vector_search.top_inner_products(data, every=10, **options).collect()))
    return got, sum(int(re.search(r"(\d+) pairs", r.getMessage())[1]) for r in caplog.records if "pairs" in r.getMessage())


def plain(vectors, k=5):
    z = np.floor(256 * vectors).astype(np.int64)
    out = []
    for q in range(0, len(z), 10):
        scores = z @ z[q]
        order = [i for i in np.lexsort((np.arange(len(z)), -scores)) if i != q][:k]
        out += [(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)]
    return sorted(out)


def clustered(count, clusters, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(clusters, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = centres[random.integers(0, clusters, count)] + 0.01 * random.normal(size=(count, 16))
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def test_clustered_vectors_send_under_a_tenth_of_the_pairs(spark, caplog):
    vectors = clustered(3000, 60, 1)
    got, sent = asked(spark, vectors, caplog, part_rows=40, query_rows=50, sample_rows=600, pivots=60)
    assert got == plain(vectors)
    annuli = 3000 / 40
    assert 0 < sent < 0.1 * 300 * annuli


@pytest.mark.parametrize("hot", [0, 400])
def test_spread_and_copied_vectors_stay_exact(spark, caplog, hot):
    random = np.random.default_rng(2)
    vectors = np.concatenate((random.normal(size=(600, 12)), np.repeat(random.normal(size=(1, 12)), hot, axis=0)))
    got, _ = asked(spark, vectors, caplog, part_rows=16, query_rows=7, sample_rows=100, pivots=8)
    assert got == plain(vectors)


def test_admitted_pairs_keep_every_winner():
    random = np.random.default_rng(5)
    z = random.integers(-99, 99, size=(400, 6)).astype(float)
    longest = (z * z).sum(1).max()
    lifted = vector_search._lifted(z, longest)
    centres = vector_search.fit_pivots(lifted, 7)
    away = vector_search._distances(lifted, centres)
    pivot, distance = away.argmin(1), away.min(1)
    ring = pivot * 10 + np.minimum(9, distance // 20).astype(int)
    names = np.unique(ring)
    annuli = np.array([(n // 10, distance[ring == n].min(), distance[ring == n].max()) for n in names])
    floor = np.sort(z[:50] @ z.T, axis=1)[:, -3]
    rows, found = vector_search.admitted(z[:50], floor, annuli, centres, longest, 0, len(annuli))
    pairs = set(zip(rows.tolist(), names[found].tolist()))
    for i, j in zip(*np.nonzero(z[:50] @ z.T >= floor[:, None])):
        assert (i, ring[j]) in pairs
    assert len(pairs) < 50 * len(names)
