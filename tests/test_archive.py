"""The archive queries against their SQL, and vectors of the format."""

import math
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.functions import mbf, text, words
from lodestack.operators import report, symbols, triage
from lodestack.queries import ORACLE_SQL, QUERIES
from lodestack.sources import binary, opcodes
from lodestack.streaming import files as stream

SF = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    clean = lambda v: None if v is None or str(v) in ("nan", "<NA>", "NaT") else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([clean(v) if type(v).__module__ != "numpy" else clean(v.item()) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "part", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_old_floats_known_values(spark):
    known = [(bytes.fromhex("00000081"), 1.0), (bytes.fromhex("00008081"), -1.0), (bytes.fromhex("00002084"), 10.0), (bytes.fromhex("00000000"), 0.0), (bytes.fromhex("00000080"), 0.5)]
    found = spark.createDataFrame(known, "raw binary, value double").select("value", mbf.decode(F.col("raw"), 24).alias("got"), mbf.encode_hex(F.col("value"), 24).alias("hex"), F.lower(F.hex("raw")).alias("raw")).collect()
    assert all(r.value == r.got and r.hex == r.raw for r in found)


def test_old_floats_errors_and_narrowing(spark):
    values = [float("nan"), float("inf"), 1e39, 1e-40, 0.1, -3.7e-3]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", mbf.encode_hex(F.col("x"), 24).alias("h"), mbf.error(F.col("x"), 24).alias("e")).collect()
    assert [r.e for r in found] == ["not finite", "not finite", "too large", None, None, None]
    assert found[3].h == "00000000"
    back = spark.createDataFrame([(bytes.fromhex(r.h),) for r in found[4:]], "raw binary").select(mbf.decode(F.col("raw"), 24)).collect()
    assert [b[0] for b in back] == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values[4:]]


def test_double_round_trip(spark):
    values = [1.0, -2.5, 0.1, 1 / 3, 1e-30, 123456789.123456, math.pi]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", mbf.decode(F.unhex(mbf.encode_hex(F.col("x"), 56)), 56).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_word_families(spark):
    cases = [(0x0D64, "PUSH_3"), (0x0165, "PUSH_INT"), (0x0508, "CINT"), (0x1108, "CDBL"), (0x000B, "LOAD"), (0x140C, "STORE$"), (0x0065, None), (0x0108, None)]
    found = spark.createDataFrame(cases, "w int, m string").select("m", words.family_mnemonic(F.col("w")).alias("got")).collect()
    assert all(r.m == r.got for r in found)


def test_expression_words():
    known = {code: op.mnemonic for code, op in opcodes.table().plain.items()}
    assert (known[0x0100], known[0x0109], known[0x015A], known[0x0166], known[0x016E], known[0x017D]) == ("ADD", "CHR$", "VAL", "PUSH_LONG", "PAREN", "DIM")


def test_chain_walk_reports_cycles_and_unknown_references(spark):
    heads = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 10)], "file_id int, bucket int, head long")
    entries = spark.createDataFrame([(1, 10, 20), (1, 20, 0), (2, 10, 20), (2, 20, 10), (3, 10, 99)], "file_id int, ref long, link long")
    found = {(r.file_id, r.ref): r.error for r in symbols.walk_chains(heads, entries).collect()}
    assert found[1, 10] is None and found[1, 20] is None
    assert found[2, 10] == "cycle" and found[3, 99] == "unknown reference"


def test_triage_and_sources(spark, tmp_path):
    (tmp_path / "a.BAS").write_bytes(b"\xfc\x00rest")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.Bas").write_bytes(b"PRINT 1\r\nX$ = \"\x85\"\r\n")
    (tmp_path / "c.bas").write_bytes(b"\xfe\x01")
    (tmp_path / "e.txt").write_bytes(b"no")
    found = {r.path.rsplit("/", 1)[1]: (r.kind, r.convertible) for r in triage.triage(binary.scan_binary(spark, str(tmp_path))).collect()}
    assert found == {"a.BAS": ("QuickBASIC 4.5", True), "b.Bas": ("plain text", False), "c.bas": ("QuickBASIC 3 or earlier", False)}
    scanned = {r.path.rsplit("/", 1)[1]: (r.kind, r.tool, r.detail) for r in triage.triage_scan(spark, str(tmp_path)).collect()}
    assert scanned == {"a.BAS": ("QuickBASIC 4.5", "this engine", ""), "b.Bas": ("plain text", "nothing to do", "already source"), "c.bas": ("QuickBASIC 3 or earlier", "untested here", "may be a protected save")}
    lost = spark.createDataFrame([("x", None, "gone")], "path string, content binary, error string")
    assert [(r.kind, r.detail) for r in triage.triage(lost).collect()] == [("unreadable", "gone")]
    empty = spark.createDataFrame([("d", bytearray())], "path string, content binary")
    assert [(r.kind, r.first_byte) for r in triage.triage(empty).collect()] == [("empty", None)]
    lines = binary.scan_text(spark, str(tmp_path / "sub")).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["PRINT 1", 'X$ = "', '"', ""]
    running = stream.triage_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.table("arrived").count() == 3


def test_numeric_literals(spark):
    cases = [("1", "integer"), ("32768", "long"), ("1.5", "single"), ("1E3", "single"), ("1D3", "double"), ("5#", "double"), ("5!", "single"), ("5&", "long"), ("5%", "integer"), ("&HFFFF", "integer"), ("&H10000", "long"), ("&H1E", "integer"), ("&O17", "integer")]
    found = spark.createDataFrame(cases, "t string, want string").select("t", "want", text.numtype(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in found), [r for r in found if r.want != r.got]


def test_lint_rules_of_the_survey(spark):
    names = ["PEN_FUNC", "UEVENT", "DEF_FN", "CHAIN", "TRON", "ADD"]
    found = spark.createDataFrame([("f", 1, i, m) for i, m in enumerate(names)], "file string, line int, pos int, mnemonic string")
    got = {r.mnemonic: r.severity for r in report.lint(found, report.rule_table(spark)).collect()}
    assert got == {"PEN_FUNC": "ignored", "UEVENT": "ignored", "DEF_FN": "rework", "CHAIN": "platform", "TRON": "ignored"}
    rules = report.rule_table(spark)
    assert (rules.where("not later").count(), rules.where("later").count()) == (25, 28)
