import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmap.functions import codec, dna


@pytest.mark.parametrize(("n", "data"), [(128, "8001"), (624485, "e58e26"), (0, "00"), (127, "7f")])
def test_numbers(n, data):
    out = bytearray()
    codec.put_number(out, n)
    assert out.hex() == data and codec.get_number(bytes(out), 0) == (n, len(out))


@pytest.mark.parametrize(("sigma", "symbol", "length", "data"), [(7, 2, 35, "f0"), (7, 1, 36, "f600"), (7, 4, 100, "f940"), (1, 0, 255, "fe"), (1, 0, 256, "ff00"), (254, 3, 1, "0300"), (255, 3, 1, "0300")])
def test_runs(sigma, symbol, length, data):
    out = bytearray()
    codec.put_run(out, sigma, symbol, length)
    assert out.hex() == data and codec.get_run(bytes(out), 0, sigma) == (symbol, length, len(out))


@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.integers(0, 1 << 20)), min_size=1, max_size=300), st.lists(st.tuples(st.integers(0, 1 << 20), st.integers(1, 1 << 20)), max_size=50))
def test_records(outgoing, runs):
    outgoing.sort()
    runs = [(s % len(outgoing), n) for s, n in runs]
    data = codec.encode_record(outgoing, runs)
    assert codec.decode_record(data) == (outgoing, runs) and codec.is_valid(data)


@pytest.mark.parametrize("data", [b"", b"\x01", b"\x01\x02", b"\x00\x05", b"\x01\x00\x00\xff", b"\x80"])
def test_broken_records(data):
    """Cut numbers, missing edges and bytes after a record without edges."""
    assert not codec.is_valid(data)


def test_dna_columns(spark):
    rows = [("ACGT",), ("A" * 15,), ("ACGTACGTACGTACGTT",), ("",), ("T" * 31,)]
    df = spark.createDataFrame(rows, "s string")
    s = F.col("s")
    got = df.select("s", dna.pack(s).alias("w"), dna.unpack(dna.pack(s), F.length(s)).alias("b"), dna.reverse_complement(s).alias("rc")).collect()
    words = {r.s: r.w for r in got}
    assert words["ACGT"] == [228] and words["A" * 15] == [-(1 << 31)] and words[""] == []
    assert all(r.s == r.b for r in got)
    one = spark.createDataFrame([("ACGTNacgtX",)], "s string").select(dna.reverse_complement(s)).first()[0]
    assert one == "XacgtNACGT"
    with pytest.raises(Exception, match="not a base"):
        spark.createDataFrame([("X",)], "s string").select(dna.base_code(s)).collect()
