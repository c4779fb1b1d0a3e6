import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import shared

def test_slices_are_bounded_and_whole():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 7), (7, 7), (7, 10))]
    got = list(shared.slices(batches, 3))
    assert [b.num_rows for b in got] == [3, 3, 1, 3] and [x for b in got for x in b.column(0).to_pylist()] == list(range(10))


def test_scratch_deletes_what_is_not_kept(spark):
    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with shared.scratch():
        with shared.scratch():
            gone, kept = shared.staged(spark.range(3), "t"), shared.staged(spark.range(4), "t", keep=True)
        assert not there(gone) and there(kept)
        free = shared.staged(spark.range(5), "t", keep=True)
    assert not there(kept) and there(free) and free.count() == 5


def test_shared_folder_is_the_clusters(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    assert shared.shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_staged_tables_are_read_back_and_can_be_forgotten(spark):
    one = shared.staged(spark.range(5), "test")
    assert one.count() == 5
    shared.forget(one)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(one.staged_at)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def test_hash_sample_is_bounded_and_spread(spark):
    got = shared.hash_sample(spark.range(20_000), F.col("id"), 100).collect()
    assert 60 <= len(got) <= 100 and max(r.id for r in got) > 10_000
    assert shared.hash_sample(spark.range(30), F.col("id"), 100).count() == 30
