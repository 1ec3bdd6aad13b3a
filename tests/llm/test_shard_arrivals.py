"""The query's store holds all columns, and takes several arrivals with a compaction after each."""

from timbrewell.llm import shards


def test_query_stores_all_columns(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stores, made = [], shards.ShardStore.__init__
    monkeypatch.setattr(shards.ShardStore, "__init__", lambda self, *a, **b: (made(self, *a, **b), stores.append(self))[0])
    calls = []
    for name in ("append", "compact"):
        monkeypatch.setattr(shards.ShardStore, name, lambda self, *a, f=getattr(shards.ShardStore, name), n=name: (calls.append(n), f(self, *a))[1])
    assert shards.shard_documents(docs).count() == docs.count()
    assert calls == ["append", "compact"] * shards.ARRIVALS and shards.ARRIVALS > 1
    assert sorted(map(str, stores[0].read().select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
