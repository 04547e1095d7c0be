"""Files that grow between micro-batches, end, and fail."""

from collections import defaultdict

from tonearm.sources.spools import SpoolSource


def test_growing_files(spark, tmp_path):
    spark.dataSource.register(SpoolSource)
    folder = tmp_path / "spool"
    folder.mkdir()
    write = lambda name, data: (folder / name).open("ab").write(data)
    write("a", b"x" * 2500)
    write("b", b"")

    def reader(name):
        live = spark.readStream.format("spool").option("path", str(folder)).option("piece", "1000").load()
        return live.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / name)).start()

    def seen(name):
        out = defaultdict(list)
        for r in spark.read.parquet(str(tmp_path / f"{name}-out")).selectExpr("*", "state <> 'data' AS last").orderBy("name", "at", "last").collect():
            out[r["name"]].append((r["at"], bytes(r["content"]), r["state"], r["error"]))
        return out

    first = reader("first")
    first.processAllAvailable()
    assert {k: [(at, len(x), s) for at, x, s, _ in v] for k, v in seen("first").items()} == {"a": [(0, 1000, "data"), (1000, 1000, "data"), (2000, 500, "data")]}
    write("a", b"y" * 700)
    write("b", b"only")
    (folder / "b.failed").write_text("connection lost")
    first.processAllAvailable()
    assert seen("first")["b"] == [(0, b"only", "data", None), (4, b"", "failed", "connection lost")]
    first.stop()
    # A later reader starts at 0; the first goes on where it was.
    (folder / "a.complete").write_text("")
    late, again = reader("late"), reader("first")
    late.processAllAvailable()
    again.processAllAvailable()
    late.stop()
    again.stop()
    assert b"".join(x[1] for x in seen("first")["a"]) == b"".join(x[1] for x in seen("late")["a"])
    whole = seen("late")["a"]
    assert b"".join(x for _, x, s, _ in whole) == b"x" * 2500 + b"y" * 700 and whole[-1][2] == "complete" and [x[2] for x in whole].count("complete") == 1
    assert [(r[2], r[3]) for r in seen("late")["b"]] == [("data", None), ("failed", "connection lost")]
