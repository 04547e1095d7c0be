"""Ogg pages: a checksum by its definition, round trips, broken and lost pages."""

import random

from tonearm.sources import ogg


def slow_checksum(data):
    x = 0
    for b in data:
        x ^= b << 24
        for _ in range(8):
            x = (x << 1) ^ (0x04C11DB7 if x & 1 << 31 else 0)
            x &= 0xFFFFFFFF
    return x


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


def stream(rng, n, serial=7):
    packets = [(rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 3000])), 960 * (i + 1)) for i in range(n)]
    return packets, ogg.write_stream(packets, serial, rng.choice([1, 3, 255]))


def test_round_trips():
    rng = random.Random(2)
    for n in (1, 2, 30):
        packets, data = stream(rng, n)
        got = list(ogg.read_packets(data))
        assert [x[3] for x in got] == [p for p, _ in packets] and not any(x[6] for x in got)
        assert all(x[2] in (None, 960 * (i + 1)) for i, x in enumerate(got)) and got[-1][2] == 960 * n
    a, b = stream(rng, 9, 1), stream(rng, 9, 2)
    pages = lambda data: [data[s:e] for s, e, own in ogg.read_pages(data)]
    mixed = [x for pair in zip(pages(a[1]) + [b""] * 99, pages(b[1]) + [b""] * 99, strict=False) for x in pair]
    got = list(ogg.read_packets(b"".join(mixed)))
    assert [[x[3] for x in got if x[0] == k] for k in (1, 2)] == [[p for p, _ in a[0]], [p for p, _ in b[0]]]


def test_broken_and_lost_pages():
    rng = random.Random(3)
    packets = [(bytes([i]) * 700, i) for i in range(12)]
    data = ogg.write_stream(packets, 5, 4)
    pages = [(s, e) for s, e, _ in ogg.read_pages(data)]
    for i in range(len(pages)):
        s, e = pages[i]
        touched = {j for j in range(12) if 3 * j < 4 * i + 4 and 3 * j + 3 > 4 * i}
        want = [packets[j][0] for j in range(12) if j not in touched]
        at = rng.randrange(s, e)
        broken = list(ogg.read_packets(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]))
        assert [x[3] for x in broken if not x[6]] == want and [(x[4], x[5]) for x in broken if x[6]] == [(s, e)]
        lost = list(ogg.read_packets(data[:s] + data[e:]))
        assert [x[3] for x in lost] == want
    assert [x[6] for x in ogg.read_packets(b"no page")] == ["DECODE_ERROR"] and [x[6] for x in ogg.read_packets(data[:-1])][-1] == "DECODE_ERROR"


def test_tables(spark):
    _, data = stream(random.Random(4), 3)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray()), (4, bytearray(b"x"))], "k long, content binary")
    got = {}
    for r in ogg.packets(df, "k").collect():
        got.setdefault(r["k"], []).append(r["error"])
    assert got == {1: [None] * 3, 2: ["INVALID_SOURCE"], 3: ["INVALID_SOURCE"], 4: ["DECODE_ERROR"]}


def test_pages_of_any_length(spark, tmp_path):
    """A second page may be shorter than 41 bytes, a text may hold the pages' mark, and of equal ids the text that is there counts."""
    import duckdb

    from tonearm.plans import catalogue, media

    texts = [(3 * n, ("xOggS" * (n % 2) + "a" * n)[:n]) for n in (0, 4, 254, 255, 699, 700, *range(950, 975), 1399, 1400, 3000)] + [(1, "b"), (1, None), (2, None)]
    spark.createDataFrame(texts, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "sequence", "n_bytes", "digest", "granule", "error"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[media.ogg_packets.__name__]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in catalogue.QUERIES["ogg_packets"](spark, str(tmp_path)).select(*columns).collect())


def test_pieces():
    import pyarrow as pa

    from tonearm.sources.batches import pieces

    for x, size in ((pa.array([b"a" * n for n in (0, 5, 90, 300, 1, 1, 1)] + [None] + [b"b" * 30] * 20, pa.binary()), 1), (pa.array([[1.0] * n for n in (0, 3, 50, 2)] + [None] + [[2.0] * 5] * 9, pa.list_(pa.float32())), 8)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), x], names=["k", "x"])
        got = list(pieces([batch, batch.slice(0, 0), batch.slice(3, 4)], "x", 100))
        assert [k for b in got for k in b.column("k").to_pylist()] == [*range(len(x)), *range(3, min(7, len(x)))]
        assert len(got) > 4 and all(sum(size * len(v or ()) for v in b.column("x").to_pylist()[1:]) < 100 for b in got)



def test_tables_are_read_in_pieces(spark, monkeypatch):
    """The rows of a batch are made Python objects a few MB at a time."""
    import pyarrow as pa

    from tonearm.sources import batches, tables

    class Rows:  # a table that runs what it is given on one batch of 64 MB
        columns, sparkSession = ["id", "content"], None

        def __init__(self, fields):
            self.schema = fields

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            batch = pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array([bytes(1 << 20)] * 64)], names=["id", "content"])
            return [b.num_rows for b in run([batch])]

    from pyspark.sql.types import StructType

    monkeypatch.setattr(tables, "small_batches", lambda _: None)
    got = tables.each(Rows(StructType.fromDDL("id long, content binary")), "content", "n long", lambda x: (len(x),))
    assert sum(got) == 64 and max(got) <= 1 + batches.BYTES // (1 << 20)
