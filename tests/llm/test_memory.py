import corpus_pipeline

from ..oracle import DATA


def test_stages_begin_with_a_full_collection(spark):
    """The driver's memory grew from stage to stage by what only a full collection gives back."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(5)
    assert len(corpus_pipeline.packed(spark, docs, DATA).select("doc_id").distinct().collect()) == 5
    assert count() > before
