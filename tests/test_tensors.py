import pytest

from tidemark.sources import tensors as N

NAN, INF = float("nan"), float("inf")
SHAPE = "i int, x array<array<double>>, y array<double>, n int"


def test_contracts_refuse_contradictions():
    with pytest.raises(ValueError, match="without a horizon"):
        N.Contract(("a",), ("up",), 2)
    with pytest.raises(ValueError, match="do not match"):
        N.Contract(("a",), ("up_h1", "up_h3"), 2, horizons=(1, 2))
    with pytest.raises(ValueError, match="repeat"):
        N.Contract(("a", "a"), ("up_h1",), 2)
    with pytest.raises(ValueError, match="side by side"):
        N.Contract(("a",), ("future_range_low_bps_h1", "future_range_high_bps_h1"), 2, "envelope")
    with pytest.raises(ValueError, match="ascending"):
        N.Contract(("a",), ("low_h5", "low_h1"), 2, "path")
    one = N.Contract(("a", "b"), ("future_range_high_bps_h1", "future_range_low_bps_h1"), 2, "envelope")
    assert one.horizons == (1, 1) and one.differs(N.Contract(("b", "a"), one.targets, 2, "envelope")) == ["features"]


def test_faults_are_counted(spark):
    k = N.Contract(("a", "b"), ("up_h1", "up_h3"), 2, "path")
    good = [[1.0, 2.0], [3.0, 4.0]]
    rows = [(1, good, [1.0, 2.0], 0), (2, good[:1], [1.0, 2.0], 0), (3, None, None, 0), (4, [[1.0], [3.0, 4.0]], [1.0, NAN], 0), (5, [None, [1.0, None]], [1.0, 2.0], 0), (6, good, [INF, 0.0], 0), (7, [], [], 0)]
    assert tuple(N.tensor_faults(spark.createDataFrame(rows, SHAPE), k).first()) == (7, 3, 2, 2, 3, 6)
    assert tuple(N.tensor_faults(spark.createDataFrame([], SHAPE), k).first()) == (0, 0, 0, 0, 0, 0)


def test_round_trip_and_refusals(spark, tmp_path):
    k = N.Contract(("a", "b"), ("up_h1", "up_h3"), 2, "path")
    path = f"{tmp_path}/t"
    N.write_tensors(spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [1.0, 2.0], 0)], SHAPE), path, k, ["i"])
    df, held = N.read_tensors(spark, path, k)
    assert held == k and df.count() == 1
    with pytest.raises(ValueError, match="differs in"):
        N.read_tensors(spark, path, N.Contract(("b", "a"), k.targets, 2, "path"))
    text = spark.read.text(f"{path}/contract").first().value
    spark.createDataFrame([(text.replace('"steps": 2', '"steps": 3'),)], "value string").write.mode("overwrite").text(f"{path}/contract")
    with pytest.raises(ValueError, match="digest"):
        N.read_tensors(spark, path)
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/contract")
    with pytest.raises(ValueError, match="0 contracts"):
        N.read_tensors(spark, path)
