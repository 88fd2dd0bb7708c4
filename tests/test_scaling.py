from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsieve.operators import kernel_map, models
from flowsieve.plans.catalogue.stream_queries import write_halves


def test_deep_trees_keep_the_nodes_of_rows_and_stay_the_same(spark):
    rows = spark.range(400).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("double").alias(f"x{i}") for i in range(4)], F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"))
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(rows).persist()
    for name, over in (("DT", {}), ("RFC", {"trees": 4})):
        estimator = models.build_model(name, label="y", weighted=False, **over)
        assert estimator.getCacheNodeIds()
        cached, plain = estimator.fit(rows), estimator.copy().setCacheNodeIds(False).fit(rows)
        assert cached.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    assert not models.build_model("XGB", label="y").getCacheNodeIds()
    rows.unpersist()


def test_halves_are_written_by_all_tasks_and_read_as_two_batches(spark, tmp_path):
    path, seen = str(tmp_path / "in"), {}
    # The second half comes in more parts than the first has files.
    rows = spark.range(0, 1000, 1, 7).withColumn("half", (F.col("id") >= 400).cast("int"))
    files = write_halves(rows, path)
    assert 1 < files < 7
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", files).parquet(path)

    def keep(batch, number):
        seen[number] = {r.id for r in batch.collect()}

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {0: set(range(400)), 1: set(range(400, 1000))}


def test_an_empty_first_half_is_one_batch(spark, tmp_path):
    rows = spark.range(0, 20, 1, 4).withColumn("half", F.lit(1))
    assert write_halves(rows, str(tmp_path / "in")) == 1
    assert spark.read.parquet(str(tmp_path / "in")).count() == 20


def test_no_mapped_row_is_written_for_kernel_machines(spark, monkeypatch):
    written = []

    def kept(df, name="stage"):
        written.append(name)
        assert set(df.columns) <= {"y", "fold", "x", "margin"}
        widest = df.select(*[F.size(c) for c in df.columns if c in ("x", "margin")]).agg(F.max(F.col("size(x)") if "x" in df.columns else F.col("size(margin)"))).first()[0]
        assert widest <= 2
        return df

    monkeypatch.setattr(kernel_map, "cut_lineage", kept)
    monkeypatch.setattr(models, "cut_lineage", kept, raising=False)
    rows = spark.range(80).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    model = kernel_map.fit_landmark_svc(rows, ["a", "b"], label="y", key="id", size=8, max_iter=2, folds=2)
    assert model.transform(rows).where(F.col("score").between(0, 1)).count() == 80
    model = models.fit_rbf_svc_approx(rows, ["a", "b"], label="y", size=8, max_iter=2)
    assert model.transform(rows).where(F.col("score").between(0, 1)).count() == 80
    assert written == ["folded", "margins", "margins"]
