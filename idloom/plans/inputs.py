"""Input rows of the queries, in SQL that Spark and DuckDB read alike: business fields, printed texts and archive records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_input(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if f"{{{t}}}" in sql})


def duck_input(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _pad(x: str, n: int) -> str:
    return f"lpad({_text(x)}, {n}, '0')"


def _control(n9: str) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({n9}, {i}, 1) AS INT)" for i, w in enumerate("657234567", 1)) + ") % 11"


def _case(on: str, *values: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def _cut(x: str, sep: str) -> str:
    return f"substr({x}, 1, 3) || '{sep}' || substr({x}, 4, 3) || '{sep}' || substr({x}, 7, 2) || '{sep}' || substr({x}, 9, 2)"


_B0 = f"""SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st, o_orderdate AS od, {_pad("(o_custkey * 7919 + 1234567) % 1000000000", 9)} AS n9, {_pad("(o_custkey * 104729 + 7654321) % 1000000000", 9)} AS m9,
  {_text("year(o_orderdate)")} AS yy, {_pad("month(o_orderdate)", 2)} AS mm, {_pad("day(o_orderdate)", 2)} AS dd, {_text("day(o_orderdate)")} AS d, {_text("month(o_orderdate)")} AS m, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {{orders}}"""
_B1 = f"""SELECT *, {_control("n9")} AS c1, {_control("m9")} AS c2, CAST(floor(cents / 100.0) AS BIGINT) AS whole, {_pad("cents % 100", 2)} AS frac, {_pad("k", 6)} AS no FROM ({_B0}) b0"""
_B2 = f"""SELECT *, n9 || CASE WHEN c1 = 10 THEN '0' ELSE {_text("c1")} END AS nip, m9 || CASE WHEN c2 = 10 THEN '0' ELSE {_text("c2")} END AS nip2,
  CASE WHEN whole >= 1000 THEN {_text("CAST(floor(whole / 1000.0) AS BIGINT)")} ELSE '' END AS th, CASE WHEN whole >= 1000 THEN {_pad("whole % 1000", 3)} ELSE {_text("whole")} END AS rest FROM ({_B1}) b1"""
_SPACED = "CASE WHEN th = '' THEN '' ELSE th || ' ' END || rest"
#: k, seq, nip, nip_text, nip2_text, number_text, number, date_text, amount_text, money and more: one row for each order, in rotating formats.
BUSINESS = f"""SELECT k, k AS seq, ck, st, nip, nip2, yy || '-' || mm || '-' || dd AS day, th || rest || '.' || frac AS money, {_SPACED} || ',' || frac AS printed, no, yy, mm, dd,
  {_case("k % 6", "nip", _cut("nip", "-"), "'PL' || nip", "'pl ' || " + _cut("nip", " "), "' ' || " + _cut("nip", "."), "CASE WHEN k % 12 = 5 THEN '' ELSE substr(nip, 1, 9) END")} AS nip_text, {_cut("nip2", "-")} AS nip2_text,
  {_case("k % 5", "'fv/' || yy || '/' || no", "'FV ' || yy || ' ' || no", "' fv_' || yy || '--' || no || '/'", "'FV-' || yy || '/' || no", "'' || no")} AS number_text,
  {_case("k % 10", "yy || '-' || mm || '-' || dd", "dd || '.' || mm || '.' || yy", "dd || '-' || mm || '-' || yy", "dd || '/' || mm || '/' || yy", "yy || '/' || mm || '/' || dd", "d || ' ' || m || ' ' || yy", "yy || mm || dd", "yy || '-' || mm || '-' || dd || ' 12:30'", "dd || '.' || mm || '.' || substr(yy, 3, 2)", "yy || '-13-4'")} AS date_text,
  {_case("k % 8", "th || rest || '.' || frac", "th || rest || ',' || frac", _SPACED + " || ',' || frac || ' zł'", "CASE WHEN th = '' THEN rest ELSE th || ',' || rest END || '.' || frac", "th || rest || '.' || frac || ' PLN'", "th || rest || '.' || frac || '5'", "'-' || th || '.' || rest || '.' || frac", "'brak'")} AS amount_text
  FROM ({_B2}) b2"""
_NL = " || chr(10) || "
_INVOICE = _NL.join(["'FAKTURA VAT nr FV/' || yy || '/' || no", "'Data wystawienia: ' || day", "'Sprzedawca NIP: ' || " + _cut("nip", "-"), "'Nabywca NIP: ' || nip2", "'Razem netto: 99,50 zl'", "'Do wplaty brutto: ' || printed || ' PLN'", "'Konto 61109010140000071219812874'"])
_RECEIPT = _NL.join(["'PARAGON FISKALNY'", "'NR: ' || substr(no, 1, 3) || '/' || yy || '/' || no", "'DATA: ' || day || '   GODZINA: 14:' || mm || ':' || dd", "'NIP: ' || " + _cut("nip", "-"), "'Kasa: 00' || CAST(k % 9 AS STRING)", "'Chleb   3,50 PLN A'", "'Mleko   4,20 PLN A'", "'SUMA PTU: 1,23 PLN'", "'SUMA: ' || printed || ' PLN'", "'GOTOWKA: 9999,00 PLN'", "'kod autoryzacji: 9' || no", "'karta ' || substr(nip, 1, 4) || ' wazna do 12/29'"])
_CONTRACT = _NL.join(["'UMOWA nr UMO/' || yy || '/' || no", "'zawarta w dniu ' || dd || '.' || mm || '.' || yy || ' o dzielo zlecenie'", "'Strona pierwsza, NIP ' || " + _cut("nip", "-"), "'Wykonawca, NIP ' || " + _cut("nip2", "-"), "'Przedmiot: prace; wynagrodzenie: ' || printed || ' PLN'"])
_HTML = _NL.join(["'<receipt><ReceiptNumber>R/' || no || '</ReceiptNumber>'", "'<IssueDate>' || day || '</IssueDate>'", "'<TotalGrossAmount>' || money || '</TotalGrossAmount>'", "'<CashRegisterNumber>07</CashRegisterNumber><Fiscal/></receipt>'"])
#: seq, full_text, forced (a type that overrules, mostly NULL): invoices, receipts, contracts, marked-up receipts and plain notes.
TEXTS = f"""SELECT seq, k, {_case("k % 5", _INVOICE, _RECEIPT, _CONTRACT, _HTML, "'Notatka ' || CAST(k % 7 AS STRING) || ' bez tresci, dnia ' || dd || '.' || mm || '.' || yy")} AS full_text,
  CASE WHEN k % 35 = 34 THEN 'PRO' END AS forced FROM ({BUSINESS}) b3"""


def records(table: str, key: str, salt: int) -> str:
    """Archive records in triples: seq, document_key, hashes, fingerprint fields (f_*), text, metadata fields (m_*), nested (whether those are nested)."""
    return f"""SELECT seq, CASE WHEN g % 5 = 0 THEN 'DOC-' || {_text("g")} ELSE 'DOC-{salt}-' || {_text("seq")} END AS document_key, CASE WHEN g % 11 = 0 THEN h END AS source_sha256, CASE WHEN g % 13 = 0 AND v < 2 THEN h ELSE '' END AS text_sha256,
  CASE WHEN g % 4 = 0 THEN {_text("100000 + g")} ELSE '' END AS f_number, CASE WHEN g % 4 = 1 AND v < 2 THEN {_pad("g", 6)} ELSE '' END AS f_auth, CASE WHEN g % 3 = 0 THEN {_pad("g * 37 % 240000", 6)} ELSE '' END AS f_time,
  CASE WHEN g % 2 = 0 THEN {_pad("g * 7 % 10000", 4)} ELSE '' END AS f_card, CASE WHEN g % 7 = 0 THEN '20250115' || {_pad("g * 11 % 240000", 6)} WHEN g % 7 = 1 THEN '202501151200' END AS f_datetime,
  CASE WHEN g % 6 = 5 THEN '' WHEN v = 2 THEN substr(h, 17, 14) || '00' ELSE substr(h, 17, 16) END AS dhash, CASE WHEN g % 10 = 9 THEN NULL WHEN v = 1 THEN substr(h, 1, 15) || '0' ELSE substr(h, 1, 16) END AS phash,
  'a ' || {_text("g % 50")} || ',11 b ' || {_text("g % 70")} || '.22 c 3,33' || CASE WHEN v = 1 THEN ' d 4,44' WHEN v = 2 THEN ' e 5,55 f 6,66 g 7,77 h 8,88 i 9,99' ELSE '' END AS text,
  CASE WHEN v = 0 THEN 'dokument' ELSE 'paragon' END AS m_type, '2025-01-' || {_pad("g % 28 + 1", 2)} AS m_date, CASE WHEN g % 17 = 0 AND v = 0 THEN 'unknown' ELSE 'Sklep ' || {_text("g % 400")} END AS m_contractor,
  CASE WHEN g % 3 = 0 AND v = 0 THEN 'kwota-nieznana' ELSE {_text("100 + g % 300")} || '.50' END AS m_amount, CASE WHEN v = 2 THEN 'pln' ELSE 'PLN' END AS m_currency, seq % 2 = 0 AS nested
  FROM (SELECT {key} AS seq, CAST(floor({key} / 3.0) AS BIGINT) AS g, ({key} + {salt}) % 3 AS v, md5({_text(f"CAST(floor({key} / 3.0) AS BIGINT)")}) AS h FROM {{{table}}}) r"""


ARCHIVE = records("customer", "c_custkey", 0)
CANDIDATES = records("supplier", "(s_suppkey * 7)", 1)
