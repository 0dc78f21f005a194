"""The index with the settings it ships with, against brute force."""

from tidemill.plans import registry, vectors


def test_default_recall(spark):
    queries, reached = vectors.recall(spark, "/root/testdata/sf0.1")
    print(f"recall {reached} of {queries} queries")
    assert queries == 40 and reached >= 0.9 and "knn_ann_recall" in registry.QUERIES


def test_kept_recall(spark):
    queries, reached = vectors.kept_recall(spark, "/root/testdata/sf0.1")
    print(f"recall {reached} of {queries} queries")
    assert queries == 40 and reached >= 0.9
