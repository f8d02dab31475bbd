from weft.__main__ import main


def test_sample_project(spark, tmp_path, capsys):
    folder = str(tmp_path / "p")
    assert main([folder, "--init"]) == 0 and main([folder, "--init"]) == 1
    assert main([folder, "--check"]) == 0 and "2 sources, 1 relations, 1 outputs" in capsys.readouterr().out
    spark.createDataFrame([(1, 1, 2e5), (2, 1, 1.0), (3, 9, 3e5)], "o_orderkey long, o_custkey long, o_totalprice double").createOrReplaceTempView("orders")
    spark.createDataFrame([(1, "Ann")], "c_custkey long, c_name string").createOrReplaceTempView("customer")
    assert main([folder, "--plan"]) == 0 and (tmp_path / "p/target/source_orders.txt").read_text().startswith("left join customer")
    assert main([folder, "--run", "--target", str(tmp_path / "out")]) == 0
    got = sorted([tuple(r) for r in spark.read.parquet(str(tmp_path / "out/large_orders")).collect()], key=str)
    assert got == [("Ann", 1), (None, 1)]
    assert main([str(tmp_path), "--check"]) == 1 and "project" in capsys.readouterr().err
