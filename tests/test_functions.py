import pytest
from pyspark.sql import functions as F

from merklake.functions import base36, checkpoints, digests, paths, timestamps
from merklake.functions.binding import let
from merklake.functions.hashing import empty_root, leaf_hash_hex, pack_hashes, unpack_hashes

MAX, MIN = 2**63 - 1, -(2**63)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column(spark, values, kind, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = {
    0: "0", 10: "a", 35: "z", 36: "10", 255: "73", 1000: "rs", -1000: "-rs",
    MAX: "1y2p0ij32e8e7", MIN: "-1y2p0ij32e8e8",
}


def test_base36_encode(spark):
    assert column(spark, list(NUMBERS), "long", base36.encode) == list(NUMBERS.values())


def test_base36_decode(spark):
    texts = {
        **{t: n for n, t in NUMBERS.items()},
        "RS": 1000, "+rs": 1000, "000rs": 1000, "-0": 0, "00000000000000000000": 0, "-000rs": -1000,
        "": None, "-": None, "+-1": None, "not@valid": None, "1 2": None, "1_0": None, "xyz!": None,
        "1y2p0ij32e8e8": None, "-1y2p0ij32e8e9": None, "zzzzzzzzzzzzzz": None, "z" * 40: None,
    }
    assert column(spark, list(texts), "string", base36.decode) == list(texts.values())


PAIRS = {
    "one": ([(1_000_000_000, 1_000_001_000)], {"0": "gjdgxs rs"}),
    "largest": ([(MAX, MAX)], {"0": "1y2p0ij32e8e7 0"}),
    "negative offset": ([(2000, 1000)], {"0": "1jk -rs"}),
}


@pytest.mark.parametrize("name", PAIRS)
def test_timestamps_build(spark, name):
    pairs, want = PAIRS[name]
    array = F.array(*[timestamps.pair(F.lit(i).cast("long"), F.lit(q).cast("long"), F.lit(t).cast("long")) for i, (q, t) in enumerate(pairs)])
    assert one(spark, timestamps.build(array)) == want


@pytest.mark.parametrize(
    "metadata, slot, want",
    [
        ({"0": "rs rs"}, 0, (1000, 2000, None)),
        ({"a": "rs rs"}, 10, (1000, 2000, None)),
        ({"73": "rs -rs"}, 255, (1000, 0, None)),
        ({"0": "rs rs"}, 1, (None, None, timestamps.MISSING)),
        ({"0": "rs3e8"}, 0, (None, None, timestamps.BAD_FORMAT)),
        ({"0": "not@valid xyz!"}, 0, (None, None, timestamps.BAD_QUEUE)),
        ({"0": "rs xyz!"}, 0, (None, None, timestamps.BAD_OFFSET)),
        ({"0": "rs 1 2"}, 0, (None, None, timestamps.BAD_OFFSET)),
        ({"0": " rs"}, 0, (None, None, timestamps.BAD_QUEUE)),
    ],
)
def test_timestamps_parse(spark, metadata, slot, want):
    df = spark.createDataFrame([(metadata, slot)], "m map<string,string>, s long")
    assert tuple(df.select(timestamps.parse(F.col("m"), F.col("s")).alias("x")).first()["x"]) == want


def test_metadata_of_a_full_bundle_fits(spark):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: timestamps.pair(i, F.lit(MAX), F.lit(MAX)))
    assert one(spark, timestamps.byte_size(timestamps.build(pairs))) == 476 + 256 * 15
    # The true worst case: both numbers at their longest.
    pairs = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: timestamps.pair(i, F.lit(MAX // 2), F.lit(-1) - F.lit(MAX // 2)))
    assert one(spark, timestamps.byte_size(timestamps.build(pairs))) <= 8192


def test_nanoseconds_survive(spark):
    values = [0, 1, -1, 1704067200123456789, -1704067200123456789]
    back = column(spark, values, "long", lambda n: timestamps.from_timestamp(timestamps.as_timestamp(n), timestamps.sub_micros(n)))
    assert back == values


PATHS = {(0, 0): "000", (67, 0): "067", (1234067, 0): "x001/x234/067", (1234067, 8): "x001/x234/067.p/8", (999, 255): "999.p/255", (1000, 1): "x001/000.p/1"}


def test_paths(spark):
    df = spark.createDataFrame([(*k, v) for k, v in PATHS.items()], "i long, p int, want string")
    for r in df.select("*", paths.index_path(F.col("i"), F.col("p")).alias("got"), paths.parse_index_path(F.col("want")).alias("back")).collect():
        assert r.got == r.want and tuple(r.back) == (r.i, r.p)
    got = one(spark, paths.tile_path(F.lit(3), F.lit(1234067), F.lit(0)))
    assert got == "tile/3/x001/x234/067"
    bad = ["", "1", "0000", "x000", "x1/000", "000/000", "000.p/0", "000.p/256", "000.p/", "abc", "-01", "x000/x000"]
    assert all(tuple(x) == (None, None) for x in column(spark, bad, "string", paths.parse_index_path))
    assert tuple(one(spark, paths.parse_entries_path(F.lit("tile/0/000")))) == (None, None)
    assert tuple(one(spark, paths.parse_entries_path(F.lit("tile/entries/x001/002.p/3")))) == (1002, 3)


def test_partial_width(spark):
    df = spark.createDataFrame([(0, 300), (1, 300), (0, 256), (1, 256), (0, 44)], "b long, n long")
    got = [tuple(r) for r in df.select(paths.partial_width(F.col("b"), F.col("n")), paths.expected_width(F.col("b"), F.col("n"))).collect()]
    assert got == [(0, 256), (44, 44), (0, 256), (0, 0), (44, 44)]


def test_names_of_indices_past_64_bits(spark):
    index = 9_000_000**2 * 900_000 + 255  # more than 2^63
    bundle = index // 256
    digits = str(bundle).zfill(-(-len(str(bundle)) // 3) * 3)
    name = "/".join(f"x{digits[i : i + 3]}" for i in range(0, len(digits) - 3, 3)) + "/" + digits[-3:]
    df = spark.createDataFrame([(str(index), str(index + 1), ""), (str(bundle * 256 + 7), str(bundle * 256 + 8), ".p/8")], "i string, n string, part string")
    wide = df.select("part", F.col("i").cast(paths.WIDE).alias("i"), F.col("n").cast(paths.WIDE).alias("n"))
    for r in wide.select("part", paths.entries_path_for_leaf(F.col("i"), F.col("n")).alias("got")).collect():
        assert r.got == f"tile/entries/{name}{r.part}"
    narrow = spark.createDataFrame([(i, n) for i in (-1, 0, 255, 256, 2**63 - 1) for n in (1, 256, 300, 2**63 - 1)], "i long, n long")
    bundles = [(paths.bundle_of(F.col("i")), paths.partial_width), (paths.wide_bundle_of(F.col("i")), paths.wide_partial_width)]
    for r in narrow.select(*[F.struct(b.cast("string"), width(b, F.col("n"))) for b, width in bundles]).collect():
        assert r[0][0] == r[1][0] and r[0][1] == r[1][1]


def test_object_paths_of_large_keys(spark, tmp_path):
    from merklake.queries.catalog import QUERIES

    spark.createDataFrame([(8_999_999, 899_999), (3, 2), (None, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    index = 8_999_999**2 * 899_999
    rows = {r.o_orderkey: r for r in QUERIES["object_paths"](spark, str(tmp_path)).collect()}
    digits = rows[8_999_999].entries_path.removeprefix("tile/entries/").split(".p/")[0].replace("x", "").replace("/", "")
    assert int(digits) == index // 256
    assert rows[3].entries_path == "tile/entries/000.p/21" and rows[None].entries_path is None


def test_checkpoint(spark):
    root = bytes(range(32))
    text = one(spark, checkpoints.render(F.lit("o/1"), F.lit(5), F.lit(bytearray(root))))
    assert text == "o/1\n5\nAAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8=\n"
    assert tuple(one(spark, checkpoints.parse(F.lit(text)))) == ("o/1", 5, bytearray(root), None)
    bad = ["", "o\n5\n", "\n5\nAA==\n", "o\n-5\nAA==\n", "o\n99999999999999999999\nAA==\n", "o\n5\n!\n"]
    codes = [x["error_code"] for x in column(spark, bad, "string", checkpoints.parse)]
    assert codes == ["CHECKPOINT_TOO_SHORT"] * 2 + ["CHECKPOINT_NO_ORIGIN"] + ["CHECKPOINT_BAD_SIZE"] * 2 + ["CHECKPOINT_BAD_ROOT"]
    data = one(spark, checkpoints.log_root_bytes(F.lit(5).cast("long"), F.lit(bytearray(root)), F.lit(7).cast("long")))
    assert data.hex() == "0001" + "0000000000000005" + "20" + root.hex() + "0000000000000007" + "00" * 10


def test_hash_helpers(spark):
    assert one(spark, empty_root()).hex() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, leaf_hash_hex(F.lit(bytearray(b"")))) == "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d"
    data = bytes(range(96))
    assert one(spark, pack_hashes(unpack_hashes(F.lit(bytearray(data))))) == data
    assert one(spark, unpack_hashes(F.lit(bytearray(data[:33])))) is None
    assert one(spark, digests.prefix(F.lit(bytearray(data[:32])))) == "0001"
    assert len(one(spark, digests.suffix(F.lit(bytearray(data[:32]))))) == 30
    assert one(spark, let(F.lit(2), lambda x: x * x + x)) == 6
