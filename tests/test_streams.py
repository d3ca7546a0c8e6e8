import pytest

from ledgerloom.plans import retrieval
from ledgerloom.streaming import watch


@pytest.fixture
def source(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(30).repartition(3).write.parquet(src)
    return spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)


def test_no_row_is_lost_with_a_batch_that_fails_once(spark, source, tmp_path):
    failed = []

    def act(df, epoch):
        if epoch == 1 and not failed:
            failed.append(epoch)
            raise RuntimeError("lost executor")
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

    watch.merged(source, act, str(tmp_path / "cp"))
    assert failed and spark.read.parquet(f"{tmp_path}/out").count() == 30


def test_a_batch_that_always_fails_is_an_error(source, tmp_path):
    def act(df, epoch):
        if epoch == 1:
            raise RuntimeError("lost executor")

    with pytest.raises(Exception, match="lost executor"):
        watch.merged(source, act, str(tmp_path / "cp"), tries=2)


def test_stream_edges_survives_a_failed_write(spark, sf, monkeypatch):
    each, failed = watch.on_each_batch, []

    def failing(stream, act, *rest, **named):
        def once(df, epoch):
            if not failed:
                failed.append(epoch)
                raise RuntimeError("lost executor")
            act(df, epoch)

        return each(stream, once, *rest, **named)

    monkeypatch.setattr(watch, "on_each_batch", failing)
    want = spark.read.parquet(f"{sf}/edges.parquet").where("edge_type = 'md_link' and dst is not null").select("src", "dst").distinct().count()
    assert retrieval.QUERIES["stream_edges"](spark, sf).first().n_edges == want and failed
