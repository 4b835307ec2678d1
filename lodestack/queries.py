"""Queries over the archive operators, and the SQL they are held against.

The test tables hold no program files, so inputs are columns of theirs, or
words, bytes and names derived from them by formulas that both engines compute
alike (the views below).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mbf, text, words
from .operators import decode, program, render, report, source, statements, structure, symbols, triage
from .plans import commands
from .sources.batches import spread
from .sources.binary import spill
from .sources.opcodes import DEFAULT, opcode_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Derived inputs, in SQL that both engines read alike.
WORDS = "select l_returnflag as file, l_linestatus as section, cast((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 65536 as int) as word, cast(l_orderkey as bigint) as line, cast(l_partkey * 8 + l_linenumber as bigint) as pos from lineitem"
DISTINCT_WORDS = f"select word, count(*) as n from ({WORDS}) w group by word"
NAMES = "select cast(p_size as int) as file_id, cast(p_partkey as bigint) as pos, p_name as name, cast(p_partkey % 3 * 2 as int) as flags, cast(p_partkey % 41 as int) as bucket from part"
PRICES = "select l_orderkey, l_partkey, l_linenumber, case when l_partkey % 2 = 0 then l_extendedprice else -l_extendedprice end as x from lineitem"


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **frames)


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def on_words(name: str, columns: Callable[[], dict], oracle: str) -> None:
    """A query of scalar columns over the distinct derived words."""
    QUERIES[name] = lambda spark, sf: _view(spark, sf, DISTINCT_WORDS, "lineitem").withColumns(columns())
    ORACLE_SQL[name] = f"select word, n, {oracle} from ({DISTINCT_WORDS}) w"


W = lambda: F.col("word")
#: The opcode table as the oracle reads it, from the same file.
_TABLE = f"""(select case when code like '%P' then ('0x' || code[:4])::int else ('0x' || code)::int end as c, code like '%P' as later, trim(f[3]) as m, trim(f[4]) as operands from
  (select trim(f[2]) as code, f from (select string_split(l, '|') as f from (select unnest(string_split(content, chr(10))) as l from read_text('{DEFAULT}')) where regexp_matches(l, '^\\| [0-9A-F]{{4}}P? \\|'))))"""
_SUFFIXED = "case word >> 8 when 0 then '' when 4 then '%' when 8 then '&' when 12 then '!' when 16 then '#' when 20 then '$' end"
_ACCESSED = "case word & 255 when 11 then 'LOAD' when 12 then 'STORE' when 13 then 'DECL' when 14 then 'ARRAY' when 15 then 'ARRSET' when 16 then 'ARRDECL' end"
_VAR = f"({_ACCESSED} || {_SUFFIXED})"
_VAR_LATER = f"({_ACCESSED} || case word >> 8 when 0 then '' when 4 then '%' when 8 then '&' when 12 then '!' when 16 then '#' when 20 then '@' when 24 then '$' end)"
_IMMEDIATE = "case when word & 255 = 100 and (word >> 8) % 4 = 1 then ((word >> 8) - 1) >> 2 end"
_CONSTANT = f"case when word & 255 = 101 and (word >> 8) % 4 = 1 then 'PUSH_INT' when ({_IMMEDIATE}) is not null then 'PUSH_' || ({_IMMEDIATE}) end"
_CONVERT = "case word when 1288 then 'CINT' when 2312 then 'CLNG' when 3336 then 'CSNG' when 4360 then 'CDBL' end"
_HEADER = "(word in (2, 3, 52, 53) or word & 1018 = 0)"
_CLASSED = f"""(select w.*, coalesce(m, {_VAR}, {_CONSTANT}, {_CONVERT}) as mnemonic,
  coalesce(operands, case when {_VAR} is not null then case when word & 255 in (14, 15, 16) then 'u16,ref' else 'ref' end when {_CONSTANT} = 'PUSH_INT' then 'u16' else '' end) as operands,
  case when {_HEADER} then 'header' when coalesce(m, {_VAR}, {_CONSTANT}, {_CONVERT}) is not null then 'opcode' else 'unidentified' end as class
  from ({WORDS}) w left join (select * from {_TABLE} where not later) o on c = word)"""

on_words("is_line_header", lambda: {"is_header": words.is_line_header(W())}, f"{_HEADER} as is_header")
on_words("indent_of", lambda: {"indent": words.indent(W())}, "word >> 10 as indent")
on_words("escaped_indent", lambda: {"indent": words.escaped_indent(W())}, "case when word & 1023 = 0 then word >> 10 else word end as indent")
on_words("variable_op", lambda: {"mnemonic": words.variable_op(W())}, f"{_VAR} as mnemonic")
on_words("variable_op_later", lambda: {"mnemonic": words.variable_op(W(), words.SUFFIX_LATER)}, f"{_VAR_LATER} as mnemonic")
on_words("constant_op", lambda: {"mnemonic": words.constant_op(W())}, f"{_CONSTANT} as mnemonic")
on_words("convert_op", lambda: {"mnemonic": words.convert_op(W())}, f"{_CONVERT} as mnemonic")
on_words("immediate_opcode", lambda: {"opcode": words.immediate_opcode(W() % 13)}, "case when word % 13 <= 10 then (((word % 13) * 4 + 1) << 8) | 100 end as opcode")
on_words("open_clauses", lambda: {"clauses": words.open_clauses(W())}, "case (word >> 8) & 3 when 1 then ' ACCESS READ' when 2 then ' ACCESS WRITE' when 3 then ' ACCESS READ WRITE' else '' end || case (word >> 8) & 112 when 16 then ' LOCK READ WRITE' when 32 then ' LOCK WRITE' when 48 then ' LOCK READ' when 64 then ' SHARED' else '' end as clauses")
on_words("param_mode_bits", lambda: words.param_bits(W()), "word & 512 <> 0 as has_suffix, word & 1024 <> 0 as is_array, word & 2048 <> 0 as by_segment, word & 4096 <> 0 as by_value, word & 8192 <> 0 as has_as")
on_words("signature_kind_bits", lambda: words.signature_bits(W()), f"(word >> 8) & 3 = 2 as is_function, word & 32768 <> 0 as cdecl, (word >> 10) & 31 as alias_len, case when word & 128 <> 0 then case word & 127 when 1 then '%' when 2 then '&' when 3 then '!' when 4 then '#' when 5 then '$' else '' end else '' end as return_suffix")
on_words("label_bucket", lambda: {"chain": words.label_bucket(W())}, "32 + ((xor(word, word >> 8) >> 1) & 7) as chain")
on_words("long_literal", lambda: {f"b{b}": text.long_literal((W() * 5).cast("bigint"), b) for b in (10, 16, 8)}, "case when word * 5 <= 32767 then (word * 5)::varchar || '&' else (word * 5)::varchar end as b10, '&H' || upper(to_hex(word * 5)) || case when word * 5 <= 65535 then '&' else '' end as b16, '&O' || printf('%o', word * 5) || case when word * 5 <= 65535 then '&' else '' end as b8")
on_words("indent_ws", lambda: {"tabs": text.indent_white(W() % 41, True), "blanks": text.indent_white(W() % 41, False)}, "repeat(chr(9), (word % 41) // 8) || repeat(' ', (word % 41) % 8) as tabs, repeat(' ', word % 41) as blanks")
on_words("declared_length", lambda: {"n_chars": F.when(W() % 256 >= 32, W() % 256 - 1)}, "case when word % 256 >= 32 then word % 256 - 1 end as n_chars")
_DEFWORD = "case (word * 3 % 65536) & 63 when 1 then 'DEFINT' when 2 then 'DEFLNG' when 3 then 'DEFSNG' when 4 then 'DEFDBL' when 5 then 'DEFSTR' else 'DEFINT' end"
_BIT = "case when i < 16 then (word >> (15 - i)::int) & 1 else ((word * 3 % 65536) >> (31 - i)::int) & 1 end = 1"
on_words("deftype_ranges", lambda: {"ranges": text.deftype_ranges(W(), (W() * 3) % 65536), "keyword": F.coalesce(words._pick((W() * 3 % 65536).bitwiseAND(F.lit(63)), words.DEFTYPES), F.lit("DEFINT"))}, f"""
  (select coalesce(string_agg(case when a = b then chr((65 + a)::int) else chr((65 + a)::int) || '-' || chr((65 + b)::int) end, ', ' order by a), '') from
    (select min(i) as a, max(i) as b from (select i, i - row_number() over (order by i) as g from range(26) r(i) where {_BIT}) group by g)) as ranges,
  {_DEFWORD} as keyword""")
on_words("deftype_state", lambda: {"types": F.array_join(text.deftype_state(W(), (W() * 3) % 65536).cast("array<string>"), "")}, f"(select string_agg(case when {_BIT} then (word * 3 % 65536) & 63 else 3 end::varchar, '' order by i) from range(26) r(i)) as types")


@query("op_lookup", f"select mnemonic, class, operands, count(*) as n, min(word) as first_word from {_CLASSED} group by mnemonic, class, operands")
def op_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Mnemonics and operand kinds of words, of statements, operators and functions and of the families."""
    found = report.classified(_view(spark, sf, WORDS, "lineitem"), opcode_table(spark))
    return found.groupBy("mnemonic", "class", F.coalesce(F.array_join("operands", ","), F.lit("")).alias("operands")).agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first_word"))


@query("stats", f"""select coalesce(file, 'TOTAL') as file, coalesce(section, 'TOTAL') as section, count(*) as opcodes, count(*) filter (class = 'unidentified') as unidentified,
  round(100.0::double * (count(*) - count(*) filter (class = 'unidentified')) / count(*), 4) as percent from {_CLASSED} where class <> 'header' group by rollup (file, section)""")
def stats(spark: SparkSession, sf: str) -> DataFrame:
    """Opcodes by section, file and in total."""
    return report.stats(report.classified(_view(spark, sf, WORDS, "lineitem"), opcode_table(spark)), "file", "section")


@query("unknown_codes", f"select word as code, count(*) as n from {_CLASSED} where mnemonic is null group by word")
def unknown_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Words without an opcode."""
    codes = _view(spark, sf, WORDS, "lineitem").withColumnRenamed("word", "code")
    return symbols.unknown_codes(codes, opcode_table(spark)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_LINT_RULES = """(values ('CALLS', 'ignored'), ('IOCTL', 'ignored'), ('IOCTL$', 'ignored'), ('ERDEV', 'ignored'), ('ERDEV$', 'ignored'), ('FILEATTR', 'ignored'), ('FRE', 'ignored'), ('SETMEM', 'ignored'), ('SIGNAL_EVENT', 'ignored'),
  ('TRON', 'ignored'), ('TROFF', 'ignored'), ('DATE$_SET', 'ignored'), ('TIME$_SET', 'ignored'), ('PEN_EVENT', 'ignored'), ('PEN_FUNC', 'ignored'), ('PLAY_EVENT_N', 'ignored'), ('UEVENT', 'ignored'), ('WIDTH_LPRINT', 'ignored'),
  ('DEF_FN', 'rework'), ('END_DEF', 'rework'), ('CHAIN', 'platform'), ('RUN_FILE', 'platform'), ('LPRINT', 'platform'), ('LOCK', 'platform'), ('UNLOCK', 'platform')) r(mnemonic, severity)"""
_FOUND = f"(select file, line, mnemonic, severity, min(pos) as pos from {_CLASSED} join {_LINT_RULES} using (mnemonic) group by file, line, mnemonic, severity)"


@query("lint_rules", f"select file, line, mnemonic, severity, pos from {_FOUND}")
def lint_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over words: the first of each mnemonic in a line."""
    found = report.classified(_view(spark, sf, WORDS, "lineitem"), opcode_table(spark))
    return report.lint(found, report.rule_table(spark))


@query("lint_report", f"select rank, s.severity, count(f.line) as n from (values (0, 'blocked'), (1, 'ignored'), (2, 'rework'), (3, 'platform')) s(rank, severity) left join {_FOUND} f on f.severity = s.severity group by rank, s.severity")
def lint_report(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by severity."""
    return report.lint_report(lint_rules(spark, sf))


_TRIAGE_IN = "select cast(l_partkey % 256 as int) as a, cast(l_suppkey % 4 as int) as b, l_orderkey % 3 = 0 as t from lineitem"
_KIND = f"case when a is null then 'empty' when a = 252 and b = 0 then 'QuickBASIC 4.5' when a = 252 and b = 2 then 'BASIC 7 PDS' else case a when 252 then 'QuickBASIC 4.5' when 253 then 'QuickBASIC 4.0' when 254 then 'QuickBASIC 3 or earlier' when 255 then 'GW-BASIC, BASICA or MSX-BASIC' when 249 then 'older Microsoft BASIC' when 241 then 'older Microsoft BASIC' when 243 then 'older Microsoft BASIC' else case when t then 'plain text' else 'unrecognised' end end end"


_TOOL = "case when a = 252 then 'this engine' when a in (253, 254) then 'untested here' when a in (255, 249, 241, 243) then 'another tool' when t then 'nothing to do' else 'none' end"


@query("triage_classify", f"select a, b, t, {_KIND} as kind, {_TOOL} as tool, case when a = 254 then 'may be a protected save' when a not in (252, 253, 255, 249, 241, 243) and t then 'already source' else '' end as detail, a = 252 as convertible, count(*) as n from ({_TRIAGE_IN}) i group by a, b, t")
def triage_classify(spark: SparkSession, sf: str) -> DataFrame:
    """What files are, by their first bytes."""
    rows = _view(spark, sf, _TRIAGE_IN, "lineitem").groupBy("a", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns(triage.verdict(F.col("a"), F.col("b"), F.col("t")))


@query("triage_report", f"select kind, count(*) as n from (select {_KIND} as kind from ({_TRIAGE_IN}) i) k group by kind")
def triage_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf, _TRIAGE_IN, "lineitem")
    return triage.triage_report(rows.select(triage.kind_of(F.col("a"), F.col("b"), F.col("t")).alias("kind")))


@query("looks_like_text", r"select doc_id, length(text) > 0 and not contains(text, chr(0)) and (length(text) - length(regexp_replace(text, '[\x01-\x08\x0B\x0C\x0E-\x19\x1B-\x1F]', '', 'g')))::double / length(text) < 0.02 as is_text from documents")
def looks_like_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.looks_like_text(F.col("text")).alias("is_text"))


@query("lex_names", r"select name, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.]*[%&!#$]?')) as name from documents) group by name")
def lex_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.explode(text.names(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_LITERALS = "select distinct cast(l_linenumber as int) as k, case l_linenumber % 7 when 0 then cast(l_partkey * 40 as varchar(20)) when 1 then cast(l_partkey as varchar(20)) || '#' when 2 then '&H' || cast(l_partkey * 9 as varchar(20)) when 3 then cast(l_partkey as varchar(20)) || '.5' when 4 then cast(l_partkey as varchar(20)) || 'E2' when 5 then cast(l_partkey as varchar(20)) || 'D2' else cast(l_partkey as varchar(20)) || '%' end as literal from lineitem"


@query("numtype", f"""select k, literal, case when literal like '%#' then 'double' when literal like '%\\%' escape '\\' then 'integer'
  when literal like '&H%' then case when ('0x' || literal[3:])::bigint <= 65535 then 'integer' else 'long' end
  when literal like '%D%' then 'double' when literal like '%.%' or literal like '%E%' then 'single'
  when literal::bigint <= 32767 then 'integer' else 'long' end as numtype from ({_LITERALS}) l""")
def numtype(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, _LITERALS, "lineitem").withColumn("numtype", text.numtype(F.col("literal")))


_LINES = "select distinct concat(repeat(' ', cast(l_linenumber as int)), repeat(chr(9), cast(l_quantity % 3 as int)), repeat(' ', cast(l_suppkey % 11 as int)), l_returnflag) as line from lineitem"


@query("source_indent", """with l as (""" + _LINES + """), c as (select line, regexp_extract(line, '^[ \\t]*') as lead from l)
  select line, list_reduce(list_prepend(0::bigint, list_transform(string_split(lead, ''), lambda ch: case when ch = chr(9) then -1 when ch = ' ' then 1 else 0 end::bigint)), lambda n, x: case when x = -1 then n + 8 - n % 8 else n + x end) as indent from c""")
def source_indent(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, _LINES, "lineitem").withColumn("indent", text.source_indent(F.col("line")).cast("bigint"))


@query("comment_align", "select p_partkey, p_name || case when p_partkey % 3 = 0 then ':' else '' end || repeat(' ', greatest(case when p_partkey % 3 = 0 then 1 else 0 end, p_size - p_partkey % 5 - length(p_name) - case when p_partkey % 3 = 0 then 1 else 0 end)::int) || chr(39) || p_brand as line from part")
def comment_align(spark: SparkSession, sf: str) -> DataFrame:
    """Comments at their column, counted from the indent, with and without a colon before them."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", text.aligned(F.col("p_name"), F.col("p_size"), F.concat(F.lit("'"), "p_brand"), F.col("p_partkey") % 5, F.col("p_partkey") % 3 == 0).alias("line"))


@query("hexdump", r"""with r as (select p_partkey, p_name, unnest(range(0, length(p_name), 16)) as off from part), p as (select p_partkey, off, substr(p_name, off::int + 1, 16) as s from r)
  select p_partkey, off::int as off, trim(regexp_replace(lower(hex(s)), '(..)', '\1 ', 'g')) as hex, regexp_replace(s, '[^\x20-\x7e]', '.', 'g') as shown from p""")
def hexdump(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", F.inline(text.hexdump(F.col("p_name").cast("binary"))))


@query("intern_names", f"select file_id, flags, arg_min(name, pos) as name, min(pos) as pos from ({NAMES}) n group by file_id, flags, lower(name)")
def intern_names(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.intern_names(_view(spark, sf, NAMES, "part"))


_LAYOUT = f"(select *, coalesce(lead(ref) over (partition by file_id, bucket order by ref), 0) as link from (select *, 86 + coalesce(sum(4 + length(name)) over (partition by file_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as ref from ({NAMES}) n))"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.name_layout(_view(spark, sf, NAMES, "part"))


@query("name_layout", f"select file_id, pos, name, flags, bucket, ref, link from {_LAYOUT}")
def name_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf)


@query("buckets", f"select file_id, bucket, min(ref) as head from {_LAYOUT} group by file_id, bucket")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.bucket_heads(_placed(spark, sf))


#: In every seventh file the chain of bucket 3 leads nowhere, and that of bucket 5 comes back to its head.
_CHAINED = f"(select *, row_number() over (partition by file_id, bucket order by ref) - 1 as step, count(*) over (partition by file_id, bucket) as n, min(ref) over (partition by file_id, bucket) as head from {_LAYOUT})"


@query("bucket_chain", f"select file_id, bucket, ref, step, null::varchar as error from {_CHAINED} union all select file_id, bucket, case bucket when 3 then 7 else head end, n, case bucket when 3 then 'unknown reference' else 'cycle' end from {_CHAINED} where step = n - 1 and file_id % 7 = 0 and bucket in (3, 5)")
def bucket_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of names, broken ones among them."""
    placed = _placed(spark, sf)
    heads = symbols.bucket_heads(placed)
    odd = (F.col("file_id") % 7 == 0) & (F.col("link") == 0)
    bent = placed.join(heads, ["file_id", "bucket"]).withColumn("link", F.when(odd & (F.col("bucket") == 3), 7).when(odd & (F.col("bucket") == 5), F.col("head")).otherwise(F.col("link")))
    return symbols.walk_chains(heads, bent)


@query("name_entry_props", f"select file_id, pos, f & 64 <> 0 as is_sub, f & 4 <> 0 and f not in (2, 6) as is_label, case when f & 64 <> 0 then 'sub' when f in (2, 6) then 'line' when f = 4 then 'label' else 'name' end as kind from (select *, case when pos % 5 = 0 then 64 else flags + case when pos % 7 = 0 then 2 else 0 end end as f from ({NAMES}) n)")
def name_entry_props(spark: SparkSession, sf: str) -> DataFrame:
    f = F.when(F.col("pos") % 5 == 0, 64).otherwise(F.col("flags") + F.when(F.col("pos") % 7 == 0, 2).otherwise(0))
    return _view(spark, sf, NAMES, "part").select("file_id", "pos", *[c.alias(k) for k, c in symbols.name_properties(f, F.col("name")).items()])


@query("subs", f"select file_id, pos, name from ({NAMES}) n where (case when pos % 5 = 0 then 64 else 0 end) & 64 <> 0")
def subs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf, NAMES, "part").withColumn("flags", F.when(F.col("pos") % 5 == 0, 64).otherwise(0))
    return symbols.subs(rows).select("file_id", "pos", "name")


_REFS = "select cast(l_partkey % 50 + 1 as int) as file_id, cast(86 + l_suppkey * 3 as bigint) as ref, cast(l_orderkey as bigint) as line from lineitem"


@query("symbol_resolve", f"select r.file_id, r.ref, coalesce(l.name, '<' || lower(lpad(to_hex(r.ref), 4, '0')) || '>') as name, count(*) as n from ({_REFS}) r left join {_LAYOUT} l on l.file_id = r.file_id and l.ref = r.ref group by 1, 2, 3")
def symbol_resolve(spark: SparkSession, sf: str) -> DataFrame:
    found = symbols.resolve(_view(spark, sf, _REFS, "lineitem"), _placed(spark, sf))
    return found.groupBy("file_id", "ref", "name").agg(F.count(F.lit(1)).alias("n"))


_LABELS = "select cast(o_custkey as bigint) as file_id, cast(o_orderkey * 6 as bigint) as off from orders"


@query("label_chain", f"select file_id, off, coalesce(lead(off) over (partition by file_id order by off) + 2, 65535) as link from ({_LABELS}) l")
def label_chain(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.label_chain(_view(spark, sf, _LABELS, "orders"))


_EXP = "case when abs(y) < pow(2.0, floor(log2(abs(y)))) then floor(log2(abs(y))) - 1 when abs(y) >= pow(2.0, floor(log2(abs(y))) + 1) then floor(log2(abs(y))) + 1 else floor(log2(abs(y))) end"


def _mbf_sql(bits: int) -> str:
    size, digits = (bits + 8) // 8, min(bits, 53)
    parts = " || ".join(f"lpad(to_hex((body >> {8 * i}) & 255), 2, '0')" for i in range(size - 1))
    return f"""with v as (select *, {'x::float::double' if bits == 24 else 'x'} as y from ({PRICES}) p), e as (select *, ({_EXP})::bigint as e from v),
    b as (select *, ((abs(y) / pow(2.0, e - {digits - 1}))::bigint << {bits - digits}) & {(1 << bits - 1) - 1} | case when y < 0 then {1 << bits - 1} else 0 end as body from e)
    select l_orderkey, l_partkey, l_linenumber, lower({parts} || lpad(to_hex(e + 129), 2, '0')) as mbf, null::varchar as error from b"""


def _mbf_encode(bits: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _view(spark, sf, PRICES, "lineitem")
        return rows.select("l_orderkey", "l_partkey", "l_linenumber", mbf.encode_hex(F.col("x"), bits).alias("mbf"), mbf.error(F.col("x"), bits).alias("error"))

    return run


def _mbf_bytes(bits: int) -> list[str]:
    size = (bits + 8) // 8
    return [f"(l_partkey * {3 + i} + l_suppkey * {i} + l_orderkey) % 256" for i in range(size - 1)] + ["(l_partkey + l_suppkey) % 256"]


def _mbf_decode_sql(bits: int) -> str:
    *body, e = _mbf_bytes(bits)
    top = 1 << bits - 1
    number = " + ".join(f"(({b})::bigint << {8 * i})" for i, b in enumerate(body))
    return f"""with b as (select l_orderkey, l_partkey, l_linenumber, {number} as body, {e} as e from lineitem)
    select l_orderkey, l_partkey, l_linenumber, case when e = 0 then 0.0::double else case when body & {top} <> 0 then -1.0::double else 1.0::double end * ((body & {top - 1}) | {top})::double * pow(2.0::double, e - {129 + bits - 1}) end as value from b"""


def _mbf_decode(bits: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        digits = [F.lpad(F.hex(F.expr(b).cast("bigint")), 2, "0") for b in _mbf_bytes(bits)]
        rows = spark.read.parquet(f"{sf}/lineitem.parquet")
        return rows.select("l_orderkey", "l_partkey", "l_linenumber", mbf.decode(F.unhex(F.concat(*digits)), bits).alias("value"))

    return run


for _bits, _name in ((24, "single"), (56, "double")):
    QUERIES[f"mbf_float_to_{_name}"], ORACLE_SQL[f"mbf_float_to_{_name}"] = _mbf_encode(_bits), _mbf_sql(_bits)
    QUERIES[f"mbf_{_name}_to_float"], ORACLE_SQL[f"mbf_{_name}_to_float"] = _mbf_decode(_bits), _mbf_decode_sql(_bits)


#: Program files of a hundred names and as many lines each, whatever the scale: a name table from part, and a stream with two instructions a line.
FILES = "select cast(p_partkey - p_partkey % 100 as bigint) as file_id, cast(p_partkey as bigint) as pos, p_name as name, cast(case p_partkey % 3 when 0 then 0 when 1 then 4 else 64 end as int) as flags, cast(p_size % 32 as int) as indent, cast(p_partkey % 65536 as int) as value from part"


def _le(number: Column) -> Column:
    """A word's bytes as hex, the low one first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 4, "0")
    return F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of files that hold the rows of FILES."""
    rows = _view(spark, sf_dir, FILES, "part")
    name = F.hex(F.encode("name", "ISO-8859-1"))
    entry = F.concat(F.lit("0000"), F.lpad(F.hex("flags"), 2, "0"), F.lpad(F.hex(F.length(name) / 2), 2, "0"), name)
    line = F.concat(_le(F.col("indent") * 1024), F.lit("0B04"), _le(F.col("value")), F.lit("6501"), _le(F.col("indent")))
    made = rows.groupBy(F.col("file_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"), line.alias("line")))).alias("all"))
    names, body = F.array_join("all.entry", ""), F.concat(F.array_join("all.line", ""), F.lit("09000800"))
    end = _le(86 + F.length(names) / 2)
    head = F.concat(F.lit("FC00" + "00" * 24), end, F.lit("00" * 82), end, F.lit("0000"))
    trailer = F.concat(F.lit("FF" * 8), _le(F.size("all")), F.lit("000000000201"))
    return spill(made.select("path", F.unhex(F.concat(head, names, _le(F.length(body) / 2), body, trailer)).alias("content")), "images")


@query("parse_names", f"select cast(file_id as varchar) as path, 86 + coalesce(sum(4 + length(name)) over (partition by file_id order by pos rows between unbounded preceding and 1 preceding), 0) as ref, flags, name from ({FILES}) f")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name tables of whole files."""
    return structure.parse_names(_images(spark, sf_dir)).where("error is null").select("path", F.col("ref").cast("bigint").alias("ref"), "flags", "name")


@query("parse_header", f"select cast(file_id as varchar) as path, 114 + sum(4 + length(name)) as names_end, false as uses_tabs from ({FILES}) f group by file_id")
def parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of whole files, by built-in functions."""
    return structure.header(_images(spark, sf_dir)).where("error is null").select("path", F.col("names_end").cast("bigint").alias("names_end"), "uses_tabs")


@query("parse_sections", f"select cast(file_id as varchar) as path, 0 as section, 10 * count(*) + 4 as declared_length, count(*) as line_count from ({FILES}) f group by file_id")
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and trailers of whole files."""
    found = structure.parse_sections(_images(spark, sf_dir)).where("error is null")
    return found.select("path", "section", F.col("declared_length").cast("bigint").alias("declared_length"), F.col("trailer.line_count").cast("bigint").alias("line_count"))


#: Programs of a hundred lines and a procedure each, whatever the scale: lines of source as the product writes them, and the mnemonics they stand for.
_STATEMENTS = {
    0: ("'A' || k || '% = ' || (size + 11) || ' + B * 2'", "'PUSH_INT LOAD PUSH_2 MULTIPLY ADD STORE%'"),
    1: ("'PRINT \"' || name || '\"; X'", "'PUSH_STR PRINT_SEMI LOAD PRINT_ITEM'"),
    2: ("'IF A' || k || ' > ' || (size + 11) || ' THEN PRINT X ELSE X = 1'", "'LOAD PUSH_INT GT IF_THEN_LINE LOAD PRINT_ITEM ELSE PUSH_1 STORE'"),
    3: ("'FOR I = 1 TO ' || (size + 11) || ' STEP 2'", "'LOAD PUSH_1 PUSH_INT PUSH_2 FOR_STEP'"),
    4: ("'DIM T' || k || '(1 TO ' || (size + 11) || ') AS INTEGER'", "'DIM PUSH_1 PUSH_INT AS_TYPE ARRDECL'"),
    5: ("'LINE (' || (size + 11) || ', 2)-(X, Y), 5, BF'", "'PUSH_INT PUSH_2 COORD LOAD LOAD COORD_TO PUSH_5 LINE'"),
    6: ("rpad('X = ABS(Y)', 24, ' ') || chr(39) || ' note ' || k", "'LOAD ABS STORE REM'"),
    7: ("'CALL S(' || (size + 11) || ', \"x\")'", "'PUSH_INT PUSH_STR CALL'"),
    8: ("k || ' GOTO ' || k", "'GOTO'"),
    9: ("'        LOCATE ' || (size + 11) || ', , 1'", "'ARG PUSH_INT ARG_OMITTED ARG PUSH_1 LOCATE'"),
    10: ("'INPUT \"n\", A$, B'", "'PUSH_STR INPUT_PROMPT LOAD$ INPUT_VARS LOAD INPUT_VARS INPUT'"),
    11: ("'OPEN \"LPT1:\" FOR OUTPUT AS #1'", "'PUSH_STR PUSH_1 FILE_NUMBER OPEN'"),
    12: ("'V = ' || size || '.25 + ' || (size + 100000)", "'PUSH_SINGLE PUSH_LONG ADD STORE'"),
    13: ("'D# = ' || (size + 11) || '.5#'", "'PUSH_DOUBLE STORE#'"),
    14: ("'CALL ABSOLUTE(Z): TRON'", "'LOAD CALL COLON TRON'"),
    15: ("'PRINT USING \"##\"; X; Y'", "'PUSH_STR PRINT_USING LOAD PRINT_SEMI LOAD PRINT_ITEM'"),
    16: ("'CASE 1, 2, ' || (size + 11)", "'PUSH_1 CASE PUSH_2 CASE PUSH_INT CASE'"),
    17: ("'CONST C' || k || ' = &H' || (size + 11) || ', E = -1'", "'CONST PUSH_HEX STORE PUSH_1 NEGATE STORE'"),
    18: ("'X = MID$(A$, 2) + MID$(B$, 2, ' || (size + 11) || ') + RND'", "'LOAD$ PUSH_2 MID$_REST LOAD$ PUSH_2 PUSH_INT MID$ ADD RND ADD STORE'"),
    19: ("'CIRCLE (1, 2), 3, , , , .5'", "'PUSH_1 PUSH_2 COORD PUSH_3 PUSH_SINGLE CIRCLE_ASPECT CIRCLE'"),
}
_KINDS = len(_STATEMENTS)
_EITHER = lambda at: "case kind " + " ".join(f"when {k} then {v[at]}" for k, v in _STATEMENTS.items()) + " end"
_PARTS = f"(select cast(p_partkey - p_partkey % 100 as bigint) as file_id, cast(p_partkey % 100 as int) as place, cast(p_partkey as int) as k, cast(p_size as int) as size, p_name as name, cast(p_partkey % {_KINDS} as int) as kind from part) p"
_BODY = f"""(select file_id, 0 as section, cast(row_number() over (partition by file_id order by place) - 1 as int) as line_no, {_EITHER(0)} as line, {_EITHER(1)} as mnemonics, kind from {_PARTS}
  union all select file_id, 1, n, case n when 0 then 'SUB S' || file_id || ' (Q%, R() AS STRING) STATIC' when 1 then '    IF Q% THEN EXIT SUB' else 'END SUB' end, case n when 0 then 'SUB' when 1 then 'LOAD% IF_THEN_LINE EXIT_SUB' else 'END_SUB' end, 100 + n
  from (select distinct file_id from {_PARTS}) f, (select 0 as n union all select 1 union all select 2) m)"""
_programs_at: dict = {}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, section, line_no, line and kind of the programs."""
    return _view(spark, sf_dir, f"select * from {_BODY} b", "part")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text: a blank line before the procedure."""
    order = F.struct("section", "line_no", F.when((F.col("section") == 1) & (F.col("line_no") == 0), F.concat(F.lit("\n"), "line")).otherwise(F.col("line")).alias("line"))
    made = _lines(spark, sf_dir).groupBy(F.col("file_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(order)).alias("all"))
    return made.select("path", F.concat(F.array_join("all.line", "\n"), F.lit("\n")).alias("text"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the programs, made once for each application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _programs_at:
        _programs_at[key] = spill(program.tokenize(_sources(spark, sf_dir)).select("path", "content", "error"), "programs")
    return _programs_at[key]


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_sections(structure.parse_sections(_programs(spark, sf_dir)))


_TEXT = f"(select cast(file_id as varchar) as path, b.* from {_BODY} b)"


@query("tokenize", f"select path, null::varchar as error, section, count(*) as line_count, true as standard from {_TEXT} t group by path, section")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source as program files: their sections, headers and errors."""
    made = _programs(spark, sf_dir)
    parts = structure.parse_sections(made).select("path", "section", F.col("trailer.line_count").cast("bigint").alias("line_count"))
    return made.select("path", "error", program.standard_header(F.col("content")).alias("standard")).join(parts, "path")


@query("image_build", "select cast(file_id as varchar) as path, 0 as bucket, 86 as head from (select distinct p_partkey - p_partkey % 100 as file_id from part)")
def image_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of whole files: the writer puts all names in the first."""
    return structure.buckets(_programs(spark, sf_dir)).where("head <> 0").select("path", "bucket", F.col("head").cast("int").alias("head"))


@query("decode_section", f"select section, line_no, mnemonic, count(*) as n from (select section, line_no, unnest(string_split(mnemonics, ' ')) as mnemonic from {_TEXT} t) group by section, line_no, mnemonic")
def decode_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of whole files with statements of many kinds, and procedures."""
    return decode.instr_rows(_decoded(spark, sf_dir)).groupBy("section", "line_no", "mnemonic").agg(F.count(F.lit(1)).alias("n"))


@query("decode_file", f"select path, section, line_no, mnemonics from {_TEXT} t")
def decode_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mnemonics of each line in order."""
    return decode.line_rows(_decoded(spark, sf_dir)).select("path", "section", "line_no", F.array_join("instrs.mnemonic", " ").alias("mnemonics"))


@query("decode_lines", f"select path, section, line_no, case when kind = 8 then 1 else length(line) - length(ltrim(line)) end::int as indent, case when kind = 8 then true else false end as labelled from {_TEXT} t")
def decode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole files, with labels and indents."""
    return decode.line_rows(_decoded(spark, sf_dir)).select("path", "section", "line_no", "indent", F.col("label_ref").isNotNull().alias("labelled"))


@query("in_sync", f"select path, section, section = 0 or path::bigint % 300 <> 0 as in_sync from {_TEXT} t group by path, section")
def in_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether as many lines come out as the trailer says; in every third file the procedure's trailer says one more."""
    parts = structure.parse_sections(_programs(spark, sf_dir))
    more = F.when((F.col("section") == 1) & (F.col("path").cast("bigint") % 300 == 0), 1).otherwise(0)
    return decode.decode_sections(parts.withColumn("trailer", F.col("trailer").withField("line_count", F.col("trailer.line_count") + more))).select("path", "section", "in_sync")


@query("words", f"select path, section, count(*) as headers from {_TEXT} t group by path, section")
def words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams as words, and how many of their lines begin where the decoder says."""
    parts = structure.parse_sections(_programs(spark, sf_dir)).select("path", "section", decode.words(F.col("body")).alias("words"))
    at = decode.line_rows(_decoded(spark, sf_dir)).select("path", "section", "offset", "header")
    same = at.join(parts, ["path", "section"]).where(F.get("words", (F.col("offset") / 2).cast("int")) == F.col("header"))
    return same.groupBy("path", "section").agg(F.count(F.lit(1)).alias("headers"))


_SHOWN = f"(select path, section, case when section = 1 then 'S' || path end as section_name, line_no, line_no + 1 as shown_no, line, kind, null::varchar as error from {_TEXT} t)"


@query("render_section", f"select path, section, section_name, line_no, shown_no, line as text, error from {_SHOWN} s")
def render_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sections as text."""
    return render.render_lines(_programs(spark, sf_dir)).drop("instrs")


@query("render_file", f"""select path, line_no, line, null::varchar as error from (select path, case when section = 1 then line_no + 1 + max(case when section = 0 then line_no + 1 end) over (partition by path) else line_no end as line_no, line from {_TEXT} t
  union all select path, count(*) filter (section = 0), '' from {_TEXT} t group by path union all select path, count(*) + 1, '' from {_TEXT} t group by path)""")
def render_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as text, with the blank lines after sections."""
    return render.render_files(_programs(spark, sf_dir)).select("path", F.col("line_no").cast("bigint").alias("line_no"), "line", "error")


@query("render_line", f"select kind, count(distinct line) as n, min(line) as least, max(line) as most from {_TEXT} t group by kind")
def render_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each kind as text."""
    shown = render.render_lines(_programs(spark, sf_dir)).select(F.col("path").cast("bigint").alias("file_id"), "section", "line_no", "text")
    kinds = _lines(spark, sf_dir).select("file_id", "section", "line_no", "kind")
    return shown.join(kinds, ["file_id", "section", "line_no"]).groupBy("kind").agg(F.countDistinct("text").alias("n"), F.min("text").alias("least"), F.max("text").alias("most"))


@query("parse_line", f"select path, line_no, regexp_replace(mnemonics, 'PUSH_(SINGLE|DOUBLE|LONG|HEX|INT|[0-9]+)', 'PUSH', 'g') as mnemonics, null::varchar as error from {_TEXT} t where kind <> 8")
def parse_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of source lines as instructions. (Lines with labels are split by the tokenizer.)"""
    ops = table(DEFAULT)
    rows = spread(_lines(spark, sf_dir).where("kind <> 8").select(F.col("file_id").cast("string").alias("path"), "line_no", "line"))
    read = lambda s: [i.mnemonic for i in statements.parse_line(s.strip(), ops)]
    found = rows.withColumn("r", source._each(read, source.RPN, "words", "line"))
    return found.select("path", "line_no", F.array_join("r.words", " ").alias("mnemonics"), "r.error")


@query("fmt", f"select path, string_agg(case when section = 1 and line_no = 0 then chr(10) || line else line end, chr(10) order by section, line_no) || chr(10) || chr(10) as after, null::varchar as error, true as changed from {_TEXT} t group by path")
def fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source with keywords in small letters, as the product writes it."""
    messy = F.regexp_replace(F.regexp_replace(F.col("text"), "PRINT ", "print "), " THEN ", " then ")
    return program.fmt(_sources(spark, sf_dir).withColumn("text", messy)).select("path", "after", "error", "changed")


@query("signatures", "select cast(file_id as varchar) as path, true as listed, false as is_function, '' as suffix, 'Q' as first_name, 'R' as second_name, 512 as first_mode, 9216 as second_mode, 1 as first_type, 5 as second_type from (select distinct p_partkey - p_partkey % 100 as file_id from part)")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of procedures, with their names."""
    found = render.signature_rows(decode.instr_rows(_decoded(spark, sf_dir)))
    known = structure.parse_names(_programs(spark, sf_dir)).select("path", "ref", "name")
    rows = found.select("path", "listed", "is_function", "suffix", F.posexplode("params").alias("k", "p")).select("path", "listed", "is_function", "suffix", "k", "p.*").join(known, ["path", "ref"], "left")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return rows.groupBy("path", "listed", "is_function", "suffix").agg(*(at(k, c).alias(f"{n}_{c}") for k, n in ((0, "first"), (1, "second")) for c in ("name", "mode", "type")))


@query("instr_text", f"select path, line_no, case kind when 6 then ' note ' || split_part(line, ' note ', 2) when 1 then split_part(line, chr(34), 2) end as said, case when kind = 6 then 24 end as comment_column from {_TEXT} t where kind in (1, 6)")
def instr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that instructions carry: comments with their column, and strings."""
    found = render.text_rows(decode.instr_rows(_decoded(spark, sf_dir))).where("section = 0")
    kinds = _lines(spark, sf_dir).where("kind in (1, 6)").select(F.col("file_id").cast("string").alias("path"), "section", "line_no")
    return found.join(kinds, ["path", "section", "line_no"]).select("path", "line_no", F.col("text").alias("said"), "comment_column")


_FINDINGS = f"""(select path, section, line_no + 1 as shown_no, keyword, severity, line from {_TEXT} t join (values (11, 'OPEN LPT1:', 'ignored'), (14, 'CALL ABSOLUTE', 'rework'), (14, 'TRON', 'ignored')) r(k, keyword, severity) on k = kind)"""


@query("lint_check", f"select path, section, shown_no, keyword, severity, line as text from {_FINDINGS} f")
def lint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of whole files: rules, routines called by name, devices."""
    return report.lint_check(_programs(spark, sf_dir)).select("path", "section", "shown_no", "keyword", "severity", "text")


@query("lint_pds_blocked", "select cast(file_id as varchar) as path, 1 as shown_no, 'BASIC 7 PDS' as keyword, 'blocked' as severity from (select distinct p_partkey - p_partkey % 100 as file_id from part)")
def lint_pds_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the later product: one finding for each as a whole. (Its streams don't decode from these, which have its version byte only.)"""
    marked = _programs(spark, sf_dir).select("path", F.unhex(F.concat(F.lit("FC02"), F.substring(F.hex("content"), 5, 1 << 30))).alias("content"))
    return report.lint_check(spill(marked, "later")).select("path", "shown_no", "keyword", "severity")


@query("stats_files", f"select coalesce(path, 'TOTAL') as file, coalesce(section::varchar, 'TOTAL') as section, count(*) as opcodes, 0::bigint as unidentified, 100.0::double as percent from (select path, section, unnest(string_split(mnemonics, ' ')) as m from {_TEXT} t) group by rollup (path, section)")
def stats_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command stats over whole files."""
    return commands.stats(spark, _programs(spark, sf_dir))


@query("dump", f"select path, section, true as standard_header, 0 as version, false as uses_tabs, case when section = 1 then 'S' || path end as name, 1::bigint as n_subs_of_its_own from {_TEXT} t group by path, section")
def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command dump: a row a section."""
    found = commands.dump(spark, _programs(spark, sf_dir))
    own = symbols.subs(structure.parse_names(_programs(spark, sf_dir))).where(F.col("name") == F.concat(F.lit("S"), "path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_subs_of_its_own"))
    return found.join(own, "path").select("path", "section", "standard_header", "version", "uses_tabs", "name", "n_subs_of_its_own")


@query("names_report", f"select path, 'line' as kind, split_part(line, ' ', 1) as name from {_TEXT} t where kind = 8 union all select distinct path, 'sub', unnest(['S', 'S' || path, 'ABSOLUTE']) from {_TEXT} t where path in (select path from {_TEXT} u group by path having count(*) > 60) union all select distinct path, 'name', 'Q' from {_TEXT} t")
def names_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command names: line numbers, procedures, and a parameter's name."""
    found = commands.names(spark, _programs(spark, sf_dir))
    whole = _lines(spark, sf_dir).groupBy(F.col("file_id").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 60").select("path", F.lit("sub").alias("kind"))
    return found.where("kind = 'line' or kind = 'name' and name = 'Q'").select("path", "kind", "name").unionByName(found.join(whole, ["path", "kind"], "left_semi").select("path", "kind", "name"))


@query("sections_report", f"select path, section, case when section = 1 then 'S' || path else '<module text>' end as name from {_TEXT} t group by path, section")
def sections_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command sections."""
    return commands.sections(spark, _programs(spark, sf_dir)).select("path", "section", "name")


@query("lines_report", f"select path, line_no, 'PUSH_INT ' || '0x' || lower(lpad(to_hex((regexp_extract(line, 'CALL S.([0-9]+)', 1))::int), 4, '0')) || ' PUSH_STR ' || chr(39) || 'x' || chr(39) || ' CALL 0x0002 S' as instructions from {_TEXT} t where kind = 7")
def lines_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command lines, where a procedure is called."""
    kinds = _lines(spark, sf_dir).where("kind = 7").select(F.col("file_id").cast("string").alias("path"), "section", "line_no")
    return commands.lines(spark, _programs(spark, sf_dir)).join(kinds, ["path", "section", "line_no"]).select("path", "line_no", "instructions")


@query("detok", f"select path, octet_length(encode(string_agg(line, chr(10) order by section, line_no)))::bigint + count(*) + 1 + 4 as n_bytes, false as has_error from {_TEXT} t group by path")
def detok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of whole programs: their size, with CRLF at each line and two blank lines."""
    return commands.detok(spark, _programs(spark, sf_dir)).select("path", F.octet_length("content").cast("bigint").alias("n_bytes"), "has_error")


SOURCES = "select p_partkey, 'A' || p_partkey || '% = (' || p_size || ' + ' || p_partkey || ') * 2 ' || chr(39) || ' note: 3' as line, case p_partkey % 4 when 0 then p_size || ' + A' || p_partkey || ' * -2 ^ 3' when 1 then 'GE * ' || p_size || ' + MID$(A$, 2)' when 2 then 'UBOUND(A) - CINT(X) + RND' else 'F(1, ' || p_size || ').Y <> INPUT$(1, #2)' end as expression from part"
DECLARATIONS = "select cast(p_partkey - p_partkey % 100 as bigint) as path, case when p_partkey % 10 = 0 then 'TYPE T' || p_size else 'DIM V' || p_partkey || '(5) AS t' || p_size end as line, p_partkey, p_size from part"


@query(
    "lex",
    """select p_partkey, (i - 1)::int as token_no, t.k as kind, t.x as text, t.s as suffix, t.n as numtype from (select p_partkey, unnest(l) as t, generate_subscripts(l, 1) as i from (select p_partkey, [
      {'k': 'NAME', 'x': 'A' || p_partkey, 's': '%', 'n': null}, {'k': 'OP', 'x': '=', 's': '', 'n': null}, {'k': 'OP', 'x': '(', 's': '', 'n': null}, {'k': 'NUMBER', 'x': p_size::varchar, 's': '', 'n': 'integer'}, {'k': 'OP', 'x': '+', 's': '', 'n': null},
      {'k': 'NUMBER', 'x': p_partkey::varchar, 's': '', 'n': case when p_partkey <= 32767 then 'integer' else 'long' end}, {'k': 'OP', 'x': ')', 's': '', 'n': null}, {'k': 'OP', 'x': '*', 's': '', 'n': null}, {'k': 'NUMBER', 'x': '2', 's': '', 'n': 'integer'},
      {'k': 'OP', 'x': chr(39), 's': '', 'n': null}, {'k': 'STRING', 'x': ' note: 3', 's': '', 'n': null}, {'k': 'END', 'x': '', 's': '', 'n': null}] as l from part))""",
)
def lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of lines."""
    lexed = source.lex_lines(_view(spark, sf_dir, SOURCES, "part"))
    return source.token_rows(lexed, "p_partkey").drop("at")


@query(
    "parse_expression",
    """select p_partkey, null::varchar as error, case p_partkey % 4 when 0 then 'PUSH ' || p_size || ' LOAD A' || p_partkey || ' PUSH 2 PUSH 3 POWER NEGATE MULTIPLY ADD' when 1 then 'LOAD GE PUSH ' || p_size || ' MULTIPLY LOAD$ A PUSH 2 MID$_REST ADD'
      when 2 then 'ARRAY 32768 A UBOUND LOAD X CINT SUBTRACT RND ADD' else 'PUSH 1 PUSH ' || p_size || ' ARRAY 2 F FIELD Y PUSH 1 PUSH 2 FILE_NUMBER INPUT$ NE' end as words from part""",
)
def parse_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions in reverse Polish: operators, variables named like operators, functions by the number of arguments, arrays and fields."""
    return source.parse_expressions(_view(spark, sf_dir, SOURCES, "part")).select("p_partkey", F.array_join("words", " ").alias("words"), "error")


@query("record_variables", f"select distinct cast(a.path as varchar) as path, 'v' || a.p_partkey as name from ({DECLARATIONS}) a join ({DECLARATIONS}) b on a.path = b.path and a.p_size = b.p_size and b.p_partkey % 10 = 0 where a.p_partkey % 10 <> 0")
def record_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of the types that their file defines."""
    return source.record_variables(_view(spark, sf_dir, DECLARATIONS, "part").withColumn("path", F.col("path").cast("string")))


@query("would_change", "select p_partkey, p_partkey % 2 = 0 as changed from part")
def would_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts differ in lines."""
    rows = _view(spark, sf_dir, "select p_partkey, p_name from part", "part")
    after = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "\n\n").otherwise("\r\n"))
    return rows.select("p_partkey", source.would_change(F.concat("p_name", F.lit("\n")), after).alias("changed"))
