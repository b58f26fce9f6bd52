"""The discovery plan finds planted motifs, in every mode, and its models can be saved."""

import pytest

from lacewing.plans import discovery as D


@pytest.fixture(scope="module")
def collection(spark):
    edges, truth = D.generate(spark, "clique", n_graphs=20, parent=10, p=0.25, size=5)
    return edges.cache(), truth.cache()


def test_certificates_beat_chance(spark, collection, tmp_path):
    edges, truth = collection
    c = D.Config(embed_mode="canonical", k_min=4, k_max=4, n_samples=40)
    model, measures = D.discover(edges, truth, c)
    rows = measures.collect()
    assert rows[0].jaccard > 0.5 and all(0 <= r.jaccard <= 1 for r in rows)
    model.save(str(tmp_path))
    again = D.Model.load(spark, str(tmp_path))
    assert again.planes is None and sorted(map(tuple, again.buckets.collect())) == sorted(map(tuple, model.buckets.collect()))


@pytest.mark.parametrize("mode", [{"embed_mode": "wl"}, {"embed_mode": "tree", "pred_mode": "subgraph"}, {"embed_mode": "wl", "clf": "knn", "knn_k": 5}, {"embed_mode": "canonical", "cc_filter": True}])
def test_modes_run(spark, collection, mode):
    edges, truth = collection
    _, measures = D.discover(edges, truth, D.Config(k_max=3, hash_dim=4, n_samples=15, **mode))
    assert all(0 <= r.jaccard <= 1 for r in measures.collect())


def test_distorted_motifs_keep_parents(spark):
    edges, truth = D.generate(spark, "star", n_graphs=5, parent=8, p=0.35, size=4, distort=1.0)
    neg = edges.filter("role = 'neg'").count()
    assert neg > 0 and edges.filter("role = 'pos'").count() > 0 and truth.count() == 25
