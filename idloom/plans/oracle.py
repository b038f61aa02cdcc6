"""DuckDB SQL for the queries: the same rules, written independently of the operators, on the same inputs."""

from __future__ import annotations

from ..operators.classify import FIELDS
from . import inputs

B, T, A, C = (inputs.duck_input(x) for x in (inputs.BUSINESS, inputs.TEXTS, inputs.ARCHIVE, inputs.CANDIDATES))
_LAST = r"'^(.*)\.([^.]*)$'"


def _s(x: str) -> str:
    return f"coalesce({x}, '')"


def _nip(x: str) -> str:
    return rf"regexp_replace(regexp_replace(upper({_s(x)}), '^[A-Z][A-Z]', ''), '[-\s.]', '', 'g')"


def _valid(n: str) -> str:
    total = " + ".join(f"{w} * (ascii(substr({n}, {i}, 1)) - 48)" for i, w in enumerate("657234567", 1))
    return f"(regexp_full_match({n}, '[0-9]{{10}}') AND ({total}) % 11 = ascii(substr({n}, 10, 1)) - 48)"


def _one_point(s: str) -> str:
    return f"CASE WHEN contains({s}, '.') THEN replace(regexp_extract({s}, {_LAST}, 1), '.', '') || '.' || regexp_extract({s}, {_LAST}, 2) ELSE {s} END"


def _amount(x: str) -> str:
    s = rf"replace(regexp_replace(upper({_s(x)}), '[ZŁPLN\s]', '', 'g'), ',', '.')"
    return f"coalesce(CAST(TRY_CAST({_one_point(s)} AS DECIMAL(38, 2)) AS VARCHAR), '0.00')"


def _printed_amount(x: str) -> str:
    s = rf"replace(regexp_replace({_s(x)}, '[^0-9,.]', '', 'g'), ',', '.')"
    d = rf"TRY_CAST(CASE WHEN regexp_matches({s}, '\.[0-9][0-9]$') THEN {_one_point(s)} ELSE {s} END AS DOUBLE)"
    return f"CASE WHEN {d} IS NULL THEN '' ELSE printf('%.2f', {d}) END"


_FORMATS = "['%Y-%m-%d', '%d-%m-%Y', '%d.%m.%Y', '%d/%m/%Y', '%Y/%m/%d', '%d %m %Y', '%Y%m%d']"


def _date(x: str) -> str:
    s = f"trim({_s(x)})"
    d = rf"regexp_extract_all({s}, '[0-9]+')"
    two = lambda i: f"lpad({d}[{i}], CAST(greatest(2, len({d}[{i}])) AS INT), '0')"
    return f"CASE WHEN {s} = '' THEN '' ELSE coalesce(CASE WHEN regexp_matches({s}, '[0-9]{{4}}') THEN strftime(try_strptime({s}, {_FORMATS}), '%Y-%m-%d') END, CASE WHEN len({d}) >= 3 THEN CASE WHEN len({d}[1]) = 4 THEN {d}[1] || '-' || {two(2)} || '-' || {two(3)} WHEN len({d}[3]) = 4 THEN {d}[3] || '-' || {two(2)} || '-' || {two(1)} END END, {s}) END"


def _printed_date(x: str) -> str:
    out = f"{x}"
    for a, z, order in (((2, 2), "", r"20\3-\2-\1"), ((2, 4), "", r"\3-\2-\1"), ((4, 2), "", r"\1-\2-\3")):
        p = rf"\b([0-9]{{{a[0]}}})[-/.]([0-9]{{2}})[-/.]([0-9]{{{a[1]}}})\b"
        out = f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_replace(regexp_extract({x}, '{p}'), '{p}', '{order}') ELSE {out} END"
    return out


def _number(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(trim(upper({_s(x)})), '[-\s_]+', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g')"


def _sha16(x: str) -> str:
    return f"upper(left(sha256({x}), 16))"


def _code(x: str) -> str:
    return f"upper(trim(nullif({x}, '')))"


def _join(*x: str) -> str:
    return f"concat_ws('|', {', '.join(x)})"


def _opt(when: str, x: str) -> str:
    return f"CASE WHEN {when} THEN {x} END"


_N, _NO, _D, _M = _nip("nip_text"), _number("number_text"), _date("date_text"), _amount("amount_text")
_P2 = _nip("nip2_text")
_CASH = [_D, _M, _opt("k % 3 <> 0 AND nip_text <> ''", _N), _opt("k % 2 = 0", "left(md5(upper('Jan ' || no)), 8)")]
IDENTITIES = {
    "invoice_id": ("FV", _join(_N, _NO, _D, _M)), "bill_id": ("RAC", _join(_N, _NO, _D, _M)), "correction_id": ("KOR", _join(_N, "'KOR/' || no", _D, _NO, _M)),
    "receipt_id": ("PAR", _join(_N, _D, _M, _opt("k % 3 <> 0", "'NR ' || no"), _opt("k % 2 = 0", "dd"))),
    "contract_id": ("UMO", _join(f"least({_N}, {_P2})", f"greatest({_N}, {_P2})", _D, _opt("k % 3 <> 0", "'UMO/' || no"), _opt("k % 4 = 0", "'NAJEM'"))),
    "bank_statement_id": ("WB", _join("'PL611090' || nip", _D, _opt("k % 3 <> 0", "'s' || no"))), "cash_in_id": ("KP", _join("'KP/' || no", *_CASH)), "cash_out_id": ("KW", _join("'KW/' || no", *_CASH)),
    "debit_note_id": ("NK", _join(_N, "'NK/' || no", _D, _M, _opt("k % 3 <> 0", _P2))), "delivery_note_id": ("WZ", _join(_N, "'WZ/' || no", _D, _opt("k % 3 <> 0", _P2))),
    "expense_id": ("DEL", _join("'EMP ' || CAST(ck AS VARCHAR)", _D, _M, _opt("k % 3 <> 0", "no"), _opt("k % 2 = 0 AND nip_text <> ''", _N))),
}
SQL: dict[str, str] = {name: f"SELECT k, canonical_string, 'DOC-{kind}-' || {_sha16('canonical_string')} AS document_id FROM (SELECT k, {canonical} AS canonical_string FROM ({B}) b) x" for name, (kind, canonical) in IDENTITIES.items()}

SQL["generic_id"] = f"""SELECT doc_id, 'DOC-' || CASE WHEN doc_id % 2 = 0 THEN 'PRO-' ELSE 'PZ-' END || {_sha16("concat_ws('|', sha256(coalesce(text, '')), CASE WHEN doc_id % 2 = 0 THEN '2024-05-02' END, CASE WHEN doc_id % 3 = 0 THEN '5213017228' END)")} AS document_id FROM documents"""
_PLAIN = lambda x: rf"trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace({x}, '[\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9.,:/@+-]+', ' ', 'g'))"
SQL["text_normalize"] = f"SELECT doc_id, {_PLAIN('text')} AS plain FROM documents"
SQL["local_document_id"] = f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'DOC-FV-' || doc_id WHEN len(p) >= 24 THEN 'LOCAL-DOC-' || {_sha16("p")} ELSE 'LOCAL-DOC-' || {_sha16("text")} END AS id,
  CASE WHEN doc_id % 10 = 0 THEN 'pipeline' ELSE 'local-fallback' END AS provider, CASE WHEN doc_id % 10 = 0 THEN 'identity' WHEN len(p) >= 24 THEN 'ocr-text' ELSE 'file-sha256' END AS source
  FROM (SELECT doc_id, text, {_PLAIN("CASE WHEN doc_id % 3 = 0 THEN source ELSE text END")} AS p FROM documents) d"""
_IDS = f"SELECT k, cs, CASE WHEN k % 5 = 0 THEN id || '0' WHEN k % 5 = 1 THEN 'no-id' WHEN k % 5 = 2 THEN replace(id, 'V', 'Q') ELSE id END AS claimed FROM (SELECT k, canonical_string AS cs, document_id AS id FROM ({SQL['invoice_id']}) y) z"
_PARTS = "string_split(claimed, '-')"
SQL["id_parse"] = f"SELECT k, CASE WHEN len(p) = 3 THEN p[1] END AS prefix, CASE WHEN len(p) = 3 THEN p[2] END AS type_code, CASE WHEN len(p) = 3 THEN p[3] END AS hash, CASE WHEN len(p) = 3 AND p[2] = 'FV' THEN 'INVOICE' END AS document_type FROM (SELECT k, {_PARTS} AS p FROM ({_IDS}) w) v"
SQL["id_verify"] = f"SELECT k, len({_PARTS}) = 3 AND coalesce({_PARTS}[3], '') = {_sha16('cs')} AS verified FROM ({_IDS}) w"

SQL["nip_normalize"] = f"SELECT k, nip, {_valid('nip')} AS valid FROM (SELECT k, {_N} AS nip FROM ({B}) b) x"
SQL["amount_normalize"] = f"SELECT k, {_M} AS amount, {_printed_amount('printed')} AS printed_amount FROM ({B}) b"
SQL["date_normalize"] = f"SELECT k, {_D} AS day, {_printed_date('date_text')} AS printed_day FROM ({B}) b"
SQL["number_normalize"] = f"SELECT k, {_NO} AS number FROM ({B}) b"

# entities: hits of each pattern in turn, the first of equal ones

_TAG = "<{0}>([^<]+)</{0}>".format
_MONEY = r"([0-9]{1,3}(?:\s?[0-9]{3})*[,.][0-9]{2})"
_AMOUNTS = [_MONEY, r"(?i)(?:brutto|netto|razem|suma|do zapłaty)[:\s]*" + _MONEY, r"(?i)([0-9]+[,.][0-9]{2})\s*(?:zł|PLN)", *["(?i)" + _TAG(t) for t in ("TotalGrossAmount", "TotalNetAmount", "TotalVATAmount", "GrossAmount", "NetAmount", "VATAmount", "UnitPrice")]]
_NIPS = [r"(?i)NIP[:\s]*([0-9]{3}[-\s]?[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{2})", r"(?i)NIP[:\s]*([0-9]{10})", "([0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9]{2})", "(?:^|[^0-9])([0-9]{10})(?:[^0-9]|$)"]
_DATE_TAGS = [_TAG(t) for t in ("IssueDate", "issue_date", "DataWystawienia", "DataWystaw")]
_DATES = [*_DATE_TAGS, *[rf"\b([0-9]{{{a}}}[-./][0-9]{{2}}[-./][0-9]{{{z}}})\b" for a, z in ((2, 4), (4, 2), (2, 2))]]
_NUMBERS = [r"(?i)(?:faktura|fv|rachunek|nr)[:\s]*([A-Z0-9/\-]+[0-9]+[A-Z0-9/\-]*)", r"(?i)(?:numer|nr)[:\s]*([A-Z]{1,3}[\s/\-]?[0-9]{1,4}[\s/\-]?[0-9]{2,4}[\s/\-]?[0-9]{2,6})", r"(?i)(FV[\s/\-]?[0-9]+[\s/\-]?[0-9]*[\s/\-]?[0-9]*)", r"(?i)(F[\s/\-]?[0-9]+[\s/\-]?[0-9]{4})", *["(?i)" + _TAG(t) for t in ("InvoiceNumber", "invoice_number", "FakturaNumer", "ReceiptNumber", "receipt_number")]]


def _hits(x: str, patterns: list[str]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({x}, '{p}', 1)" for p in patterns) + "])"


def _firsts(h: str) -> str:
    return f"list_filter({h}, lambda x, i: list_position({h}, x) = i)"


def _entities(rows: str, text: str) -> str:
    """The rows with arrays nips, amounts, dates, numbers."""
    hits = f"SELECT *, list_filter(list_transform({_hits(text, _NIPS)}, lambda m: regexp_replace(m, '[-\\s]', '', 'g')), lambda n: {_valid('n')}) AS h1, list_transform({_hits(text, _AMOUNTS)}, lambda m: replace(replace(replace(m, ' ', ''), chr(160), ''), ',', '.')) AS h2, {_hits(text, _DATES)} AS h3, list_filter(list_transform({_hits(text, _NUMBERS)}, lambda m: upper(regexp_replace(m, '^\\s+|\\s+$', '', 'g'))), lambda m: len(m) >= 4) AS h4 FROM ({rows}) r0"
    return f"SELECT * EXCLUDE (h1, h2, h3, h4), {_firsts('h1')} AS nips, {_firsts('h2')} AS amounts, {_firsts('h3')} AS dates, {_firsts('h4')} AS numbers FROM ({hits}) r1"


_E = _entities(T, "full_text")
_list = lambda x: f"array_to_string({x}, '; ')"
SQL["find_entities"] = f"SELECT seq, {_list('nips')} AS nips, {_list('amounts')} AS amounts, {_list('dates')} AS dates, {_list('numbers')} AS invoice_numbers FROM ({_E}) e"
_MT = lambda x: f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '[0-9]{{1,4}}[.,][0-9]{{2}}'), lambda m: replace(m, ',', '.'))))"
_TRACE = {"number": (r"(?:rachunek|paragon|faktura)\s*nr\b[^0-9]{0,6}([0-9]{3,})", r"\bnr\b[^0-9]{0,4}([0-9]{4,})"), "auth": (r"(?:autoryzacji|ryzacji|authoriz\w*|\bcji)\b[^0-9]{0,6}([0-9]{4,})", r"([0-9]{5,7})\s*\(\s*1\s*\)")}


def _first(x: str, *patterns: str, group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', {group}), '')" for p in patterns) + ")"


_CL = r"\b([0-2]?[0-9]):([0-5][0-9])"
_HMS = [f"nullif(regexp_extract(full_text, '{_CL}:([0-5][0-9])\\b', {i}), '')" for i in (1, 2, 3)]
_HM = [f"nullif(regexp_extract(full_text, '{_CL}(?::([0-5][0-9]))?\\b', {i}), '')" for i in (1, 2, 3)]
_YMD = r"coalesce(nullif(regexp_replace(regexp_extract(full_text, '\b20[0-9]{2}[-./][0-9]{2}[-./][0-9]{2}\b'), '[-./]', '', 'g'), ''), nullif(regexp_replace(regexp_extract(full_text, '\b[0-9]{2}[-./][0-9]{2}[-./]20[0-9]{2}\b'), '([0-9]{2}).([0-9]{2}).([0-9]{4})', '\3\2\1'), ''))"
SQL["payment_traces"] = f"""SELECT seq, coalesce({_first("lower(full_text)", *_TRACE["number"])}, '') AS number, coalesce({_first("lower(full_text)", *_TRACE["auth"])}, '') AS auth,
  coalesce(lpad({_HMS[0]}, 2, '0') || {_HMS[1]} || {_HMS[2]}, '') AS time, coalesce({_first("lower(full_text)", r"\b([0-9]{4})\b\s*wa\w?zna\s*do")}, '') AS card, {_YMD} || lpad({_HM[0]}, 2, '0') || {_HM[1]} || coalesce({_HM[2]}, '') AS datetime FROM ({T}) t"""

# classification


def _count(words: str) -> str:
    return "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words.split()) + ")"


_p = lambda when, w: f"CASE WHEN {when} THEN {w}::DOUBLE ELSE 0::DOUBLE END"
_SCORES = f"""SELECT *, least(1.0::DOUBLE, {_count("faktura fv rachunek invoice sprzedawca nabywca nip vat brutto netto podatek")} * 0.15::DOUBLE + {_p("len(nips) > 0", 0.2)} + {_p("len(amounts) > 0", 0.2)} + {_p("len(numbers) > 0", 0.2)}) AS invoice,
  least(1.0::DOUBLE, {_count("paragon fiskalny kasa sprzedaż gotówka karta reszta ptu suma")} * 0.15::DOUBLE + {_p("contains(low, 'fiskaln') OR contains(low, 'paragon')", 0.3)} + {_p("contains(low, 'ptu') OR regexp_matches(low, '[0-9]+%')", 0.2)} + {_p("regexp_matches(low, '(?s)<receipt[^>]*>.*?</receipt>')", 0.4)} + {_p("regexp_matches(low, '<receiptnumber|<cashregister|<fiscal')", 0.3)}) AS receipt,
  least(1.0::DOUBLE, {_count("umowa kontrakt porozumienie zlecenie strona wykonawca zamawiający zleceniodawca przedmiot wynagrodzenie termin")} * 0.1::DOUBLE + {_p("contains(low, 'umowa') OR contains(low, 'kontrakt')", 0.3)} + {_p("contains(low, 'strona') OR contains(low, 'wykonawca')", 0.2)}) AS contract
  FROM (SELECT *, lower(full_text) AS low FROM ({_E}) e) e1"""
_CATEGORY = f"SELECT *, CASE WHEN greatest(invoice, receipt, contract) <= 0.4::DOUBLE THEN 'unknown' WHEN invoice >= greatest(receipt, contract) THEN 'invoice' WHEN receipt >= contract THEN 'receipt' ELSE 'contract' END AS category FROM ({_SCORES}) s"
SQL["classify_texts"] = f"SELECT seq, invoice, receipt, contract, category FROM ({_CATEGORY}) c"

_NUM = r"([0-9][0-9\s,.]*[0-9])"
_TOK, _DIG = r"([A-Z0-9/\-]+)", r"([A-Z0-9/\-]*[0-9]+[A-Z0-9/\-]*)"
_INV_NO = [r"(?i)\b(?:faktura|fv|rachunek|dokumentu)\b\s*(?:vat)?\s*(?:nr|numer)?[:\s]+" + _DIG, r"(?i)\b(?:nr|numer)\b\s*(?:faktury|fv|dokumentu)?[:\s]+" + _DIG, *[_TAG(t) for t in ("InvoiceNumber", "invoice_number", "FakturaNumer")]]
_AD = r"([0-9]{2,4}[-./][0-9]{2}[-./][0-9]{2,4})"
_ISSUED = [r"(?i)data\s*wystawienia[:\s]*" + _AD, r"(?i)wystawion[ao]\s*(?:dnia)?[:\s]*" + _AD, r"(?i)data[:\s]*" + _AD, *_DATE_TAGS]
_SIGNED = [rf"(?i){x}[:\s]*([0-9]{{2}}[-./][0-9]{{2}}[-./][0-9]{{4}})" for x in (r"zawarta\s*(?:w\s*dniu)?", "dnia", "data")]
_NOSUM = r"regexp_replace(full_text, '(?i)suma\s+(ptu|vat)', '-', 'g')"  # RE2 has no lookahead
_TOTAL = "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for x, p in ((_NOSUM, r"(?i)suma[:\s]*" + _NUM), ("full_text", r"(?i)razem[:\s]*" + _NUM), ("full_text", r"(?i)do zapłaty[:\s]*" + _NUM), ("full_text", "(?i)" + _TAG("TotalGrossAmount")), ("full_text", r"(?i)<span>suma:</span>\s*<span>" + _NUM + "</span>"), (_NOSUM, "(?i)suma[^0-9]*?" + _NUM))) + ")"
_max = lambda l: f"printf('%.2f', list_max(list_transform({l}, lambda a: coalesce(TRY_CAST({_printed_amount('a')} AS DOUBLE), 0.0))))"  # noqa: E731, E741
_label = lambda w, t: f"nullif({_printed_amount(_first('full_text', _TAG(t), f'(?i){w}[:' + chr(92) + 's]*' + _NUM))}, '')"
_UNPAID = r"list_filter(amounts, lambda a: NOT regexp_matches(full_text, '(?i)(?:gotówka|karta|płatność)[:\s]*' || a))"
_RNO, _RCASH = _first("full_text", r"(?i)(?:nr|numer)\s*(?:paragonu)?[:\s]*" + _TOK, _TAG("ReceiptNumber")), _first("full_text", r"(?i)(?:kasa|stanowisko)[:\s]*([0-9]+)", _TAG("CashRegisterNumber"))
_seen = lambda found: f"coalesce({_printed_date(found)}, {_printed_date('dates[1]')})"
_KIND = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{n}'" for w, n in (("zlecenie", "ZLECENIE"), ("o dzieło", "DZIELO"), ("najmu", "NAJEM"), ("sprzedaży", "SPRZEDAZ"), ("współpracy", "WSPOLPRACA"), ("o pracę", "PRACA"))) + " END"
_FOUND = {
    "document_date": {"invoice": _seen(_first("full_text", *_ISSUED)), "receipt": _printed_date("dates[1]"), "contract": _seen(_first("full_text", *_SIGNED)), "unknown": "dates[1]"},
    "issuer_nip": dict.fromkeys(("invoice", "receipt", "contract", "unknown"), "nips[1]"), "buyer_nip": {"invoice": "nips[2]"}, "party2_nip": {"contract": "nips[2]"},
    "invoice_number": {"invoice": f"coalesce(upper(trim({_first('full_text', *_INV_NO)})), numbers[1])"},
    "gross_amount": {"invoice": f"coalesce({_label('brutto', 'TotalGrossAmount')}, CASE WHEN len(amounts) > 0 THEN {_max('amounts')} END)", "receipt": f"CASE WHEN {_TOTAL} IS NOT NULL THEN nullif({_printed_amount(_TOTAL)}, '') WHEN len({_UNPAID}) > 0 THEN {_max(_UNPAID)} END"},
    "net_amount": {"invoice": _label("netto", "TotalNetAmount")}, "vat_amount": {"invoice": _label("(?:vat|podatek)", "TotalVATAmount")},
    "receipt_number": {"receipt": _RNO}, "cash_register_number": {"receipt": f"CASE WHEN {_RNO} IS NULL OR NOT contains({_RNO}, {_RCASH}) THEN {_RCASH} END"},
    "contract_number": {"contract": f"upper({_first('full_text', r'(?i)umowa\s*(?:nr|numer)?[:\s]*' + _TOK, r'(?i)(?:nr|numer)\s*(?:umowy)?[:\s]*' + _TOK)})"}, "contract_type": {"contract": _KIND},
}


def _field(name: str, category: str) -> str:
    return "CASE " + category + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _FOUND[name].items()) + " END"


_X = f"SELECT *, {', '.join(f'{_field(f, "category")} AS {f}' for f in FIELDS)} FROM ({_CATEGORY}) c"
_typed = f"SELECT *, coalesce(forced, CASE category WHEN 'invoice' THEN 'FV' WHEN 'receipt' THEN 'PAR' WHEN 'contract' THEN 'UMO' ELSE 'DOC' END) AS document_type, {_nip('issuer_nip')} AS n1, {_nip('party2_nip')} AS n2, {_date('document_date')} AS dy, {_amount("coalesce(nullif(gross_amount, ''), '0')")} AS am, sha256(full_text) AS sh FROM ({_X}) x"
_KINDS = "CASE document_type WHEN 'FV' THEN {} WHEN 'PAR' THEN {} WHEN 'UMO' THEN {} ELSE {} END"
_SHOWN = _KINDS.format(_join("n1", f"upper({_s('invoice_number')})", "dy", "am"), _join("n1", "dy", "am", "receipt_number", "cash_register_number"), _join("least(n1, n2)", "greatest(n1, n2)", "dy", "upper(contract_number)"), _join("left(sh, 32)", "dy", "n1"))
_HASHED = _KINDS.format(_join("n1", _number("invoice_number"), "dy", "am"), _join("n1", "dy", "am", _code("receipt_number"), _code("cash_register_number")), _join("least(n1, n2)", "greatest(n1, n2)", "dy", _code("contract_number")), _join("sh", "CASE WHEN document_date <> '' THEN dy END", "CASE WHEN issuer_nip <> '' THEN n1 END"))
_PROCESSED = f"SELECT *, {_SHOWN} AS canonical_string, 'DOC-' || document_type || '-' || {_sha16(_HASHED)} AS document_id FROM ({_typed}) y"
SQL["process_documents"] = f"SELECT seq, category, document_type, canonical_string, document_id, {', '.join(FIELDS)} FROM ({_PROCESSED}) p"
_PRIOR = f"SELECT *, first_value(document_id) OVER (PARTITION BY canonical_string ORDER BY seq) AS prior FROM ({_PROCESSED}) p"
SQL["prior_duplicates"] = f"SELECT seq, document_id, prior <> document_id AS is_duplicate, CASE WHEN prior <> document_id THEN prior END AS duplicate_of FROM ({_PRIOR}) q"
_GIVEN = _PRIOR.replace(f"FROM ({_PROCESSED}) p", f"FROM ({_PROCESSED}) p WHERE seq % 50 <> 7")
SQL["process_batch"] = f"SELECT seq, document_id, document_type, canonical_string FROM ({_GIVEN}) q WHERE prior = document_id"
_SHORT = lambda x: f"CASE WHEN count(DISTINCT {x}) <= 5 THEN string_agg(DISTINCT {x}, ', ' ORDER BY {x}) ELSE count(DISTINCT {x}) || ' unique IDs' END"
SQL["ids_by_category"] = f"SELECT category, {_SHORT('document_type')} AS types, {_SHORT('document_id')} AS ids FROM ({_PROCESSED}) p WHERE seq IN (SELECT seq FROM ({T}) t WHERE full_text LIKE 'Notatka%' OR k < 40) GROUP BY category"
SQL["batch_report"] = f"SELECT count(*) AS n_documents, count_if(prior <> document_id) AS n_duplicates, 1.0::DOUBLE AS mean_confidence, count(DISTINCT document_id) AS n_ids, count(DISTINCT document_id) = 1 AS all_same FROM ({_PRIOR}) q"
SQL["type_counts"] = f"SELECT document_type, count(*) AS n FROM ({_PROCESSED}) p GROUP BY document_type"
SQL["determinism"] = f"SELECT seq, 5 AS n_runs, 1 AS n_ids, true AS same FROM ({T}) t"
_PLAINLY = _PROCESSED.replace("coalesce(forced, CASE category", "(CASE category")
SQL["verify_documents"] = f"SELECT seq, seq % 2 <> 0 AND document_id = 'DOC-DOC-' || {_sha16('sh')} AS verified FROM ({_PLAINLY}) p"
SQL["extract_all"] = f"""SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, o) - 1 AS rank, category, confidence, document_date, issuer_nip FROM (
  SELECT seq, u.c AS category, u.s AS confidence, u.o AS o, {_field("document_date", "u.c")} AS document_date, nips[1] AS issuer_nip FROM
  (SELECT *, unnest([{{'c': 'invoice', 's': invoice, 'o': 0}}, {{'c': 'receipt', 's': receipt, 'o': 1}}, {{'c': 'contract', 's': contract, 'o': 2}}]) AS u FROM ({_SCORES}) s) v WHERE u.s > 0.4::DOUBLE) w"""
SQL["find_document_amounts"] = f"""SELECT doc_id, CAST(len(text) AS BIGINT) AS n, {_list("amounts")} AS amounts, {_list(_MT("text"))} AS money FROM ({_entities("SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html FROM pages", "text")}) e"""
SQL["batch_duplicates"] = f"SELECT 'DOC-DOC-' || {_sha16('sha256(text)')} AS document_id, count(*) AS n_files, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS files FROM documents GROUP BY text HAVING count(*) > 1"
SQL["engine_report"] = "SELECT event_type AS engine, count(*) AS n_runs, count(DISTINCT user_id) AS n_ids, count(DISTINCT user_id) = 1 AS deterministic, round(avg(value % 1), 6) AS mean_confidence, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type"

# hashes

_hex = lambda b: "array_to_string(list_transform(range(16), lambda q: substr('0123456789abcdef', CAST(1 + " + " + ".join(f"{8 >> j} * {b}[4 * q + {j + 1}]" for j in range(4)) + " AS BIGINT), 1)), '')"
_G = "SELECT vec_id AS seq, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64"
_HASHES = f"SELECT seq, {_hex('b')} AS phash, {_hex('d')} AS dhash FROM (SELECT seq, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, list_transform(range(1, 65), lambda i: CASE WHEN e[i] > e[CASE WHEN i = 64 THEN 1 ELSE i + 1 END] THEN 1 ELSE 0 END) AS d FROM ({_G}) g) h"
_dist = lambda a, b: f"CAST(bit_count(xor(('0x' || {a})::UBIGINT, ('0x' || {b})::UBIGINT)) AS INT)"
SQL["grid_hashes"] = f"SELECT seq, {_hex('b')} AS ahash, {_hex('d')} AS dhash FROM (SELECT seq, list_transform(e, lambda x: CASE WHEN x >= m THEN 1 ELSE 0 END) AS b, list_transform(range(1, 65), lambda i: CASE WHEN e[i] > e[CASE WHEN i % 8 = 0 THEN i - 7 ELSE i + 1 END] THEN 1 ELSE 0 END) AS d FROM (SELECT *, list_reduce(e, lambda a, x: a + x) / 64 AS m FROM ({_G}) g) g1) h"
SQL["hamming"] = f"SELECT seq, d AS distance, 1 - d / 64.0::DOUBLE AS similarity, 999 AS far, d <= 40 AS same FROM (SELECT seq, {_dist('phash', 'dhash')} AS d FROM ({_HASHES}) h) x"
_PAIRS = f"SELECT a.seq, b.seq AS match_seq, {_dist('a.dhash', 'b.dhash')} AS d, {_dist('a.phash', 'b.phash')} AS p FROM ({_HASHES}) a, ({_HASHES}) b"
SQL["visual_rank"] = f"SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance, match_seq) AS place FROM (SELECT seq, match_seq, least(d, p) AS distance, greatest(d, p) <= 12 AS same, greatest(0.0::DOUBLE, 1 - least(d, p) / 64.0::DOUBLE) * 100 AS similarity FROM ({_PAIRS} WHERE a.seq % 100 = 0) q) w"
#: The low cosine products of an 8 x 8 grid: sums over its rows, then over its columns; bits above the median of all but the first.
_COS = "SELECT k, n, cos(pi() * (2 * k + 1) * n / 16) AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(8)) AS n)"
_CELLS = f"SELECT seq, CAST(floor(i / 8) AS BIGINT) AS y, i % 8 AS x, e[i + 1] AS v FROM (SELECT seq, e, unnest(range(64)) AS i FROM ({_G}) g)"
_ROWS = f"SELECT seq, y, k AS kx, sum(v * w) AS v FROM ({_CELLS}) c JOIN ({_COS}) b ON b.n = c.x GROUP BY ALL"
_DCT = f"SELECT seq, k * 8 + kx AS i, sum(v * w) AS v FROM ({_ROWS}) r JOIN ({_COS}) b ON b.n = r.y GROUP BY ALL"
SQL["grid_phash"] = f"SELECT seq, {_hex('b')} AS phash FROM (SELECT seq, list(CASE WHEN v > m THEN 1 ELSE 0 END ORDER BY i) AS b FROM (SELECT *, median(v) FILTER (WHERE i > 0) OVER (PARTITION BY seq) AS m FROM ({_DCT}) d) e GROUP BY seq) f"

# archive records

_UNKNOWN = "('', 'ina-gruba', 'kontrahent-nieznany', 'kwota-nieznana', 'nieznana', 'unknown')"


def _sig(rows: str) -> str:
    low = lambda f: f"lower(trim({_s('m_' + f)}))"
    return f"""SELECT *, coalesce(f_datetime, '') AS dt, {_s("phash")} AS ph, {_MT("text")} AS money, {_s("source_sha256")} AS ss,
      CASE WHEN {low("amount")} NOT IN {_UNKNOWN} THEN 2 ELSE 0 END + CASE WHEN {low("contractor")} NOT IN {_UNKNOWN} THEN 1 ELSE 0 END + CASE WHEN {low("date")} <> '' THEN 1 ELSE 0 END + CASE WHEN {low("type")} NOT IN ('', 'dokument') THEN 1 ELSE 0 END AS completeness,
      CASE WHEN {low("contractor")} NOT IN {_UNKNOWN} AND {low("date")} <> '' AND {low("amount")} NOT IN {_UNKNOWN} THEN {low("contractor")} || '|' || {low("date")} || '|' || {low("amount")} || '|' || {low("currency")} END AS key FROM ({rows}) rec"""


def _reason(by_document: bool) -> str:
    n = " + ".join(f"CAST(n.f_{f} <> '' AND n.f_{f} = o.f_{f} AS INT)" for f in ("number", "auth", "time", "card"))
    far = lambda f: f"CASE WHEN n.{f} = '' OR o.{f} = '' THEN 999 ELSE {_dist(f'n.{f}', f'o.{f}')} END"
    shared, union = "len(list_intersect(n.money, o.money))", "len(list_distinct(list_concat(n.money, o.money)))"
    docs = "WHEN n.ss <> '' AND n.ss = o.ss THEN 'source_sha256' WHEN n.text_sha256 <> '' AND n.text_sha256 = o.text_sha256 THEN 'text_sha256'" if by_document else ""
    return f"""CASE WHEN n.document_key <> '' AND n.document_key = o.document_key THEN '{"document" if by_document else ""}' {docs} WHEN n.dt = o.dt AND len(n.dt) >= 14 THEN 'datetime' WHEN ({n}) >= 2 THEN 'fingerprint:' || ({n})
      WHEN ({n}) >= 1 AND n.dhash <> '' AND ({far("dhash")}) <= 10 THEN 'fingerprint+visual' WHEN n.ph <> '' AND o.ph <> '' AND ({far("ph")}) <= 6 AND (n.dhash = '' OR o.dhash = '' OR ({far("dhash")}) <= 6) THEN 'visual-strong'
      WHEN n.key = o.key AND (({shared} >= 3 AND {shared} / ({union})::DOUBLE >= 0.4) OR (n.dhash <> '' AND o.dhash <> '' AND ({far("dhash")}) <= 14)) THEN 'business-key' ELSE '' END"""


SQL["completeness"] = f"SELECT seq, completeness, coalesce(key, '') AS key FROM ({_sig(A)}) s"
SQL["money_overlap"] = f"SELECT a.seq, len(list_intersect(a.money, b.money)) AS shared, len(list_intersect(a.money, b.money)) / len(list_distinct(list_concat(a.money, b.money)))::DOUBLE AS jaccard FROM ({_sig(A)}) a JOIN ({_sig(A)}) b ON b.seq = a.seq + 1"
_near = lambda f: f"CASE WHEN n.{f} <> '' AND o.{f} <> '' THEN {_dist(f'n.{f}', f'o.{f}')} END"
SQL["best_match"] = f"""SELECT seq, match_seq, distance, 1 - distance / 64.0::DOUBLE AS similarity FROM (SELECT n.seq, o.seq AS match_seq, {_near("dhash")} AS d, {_near("ph")} AS p, least(d, p) AS distance FROM ({_sig(C)}) n, ({_sig(A)}) o) q
  WHERE greatest(d, p) <= 6 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY distance, match_seq) = 1"""
_WITHIN = f"SELECT * FROM (SELECT n.seq AS seq_new, o.seq AS seq_old, {_reason(False)} AS reason FROM ({_sig(A)}) n JOIN ({_sig(A)}) o ON n.seq < o.seq) m WHERE reason <> ''"
SQL["match_pairs"] = _WITHIN
_ACROSS = f"SELECT * FROM (SELECT n.seq AS seq, o.seq AS match_seq, {_reason(True)} AS reason, n.completeness AS new_completeness, o.completeness AS existing_completeness FROM ({_sig(C)}) n, ({_sig(A)}) o) m WHERE reason <> ''"
_LASTS = f"SELECT * FROM ({_ACROSS}) x QUALIFY row_number() OVER (PARTITION BY seq ORDER BY match_seq DESC) = 1"
SQL["find_duplicates"] = f"SELECT seq, match_seq, reason FROM ({_LASTS}) y"
SQL["evaluate"] = f"SELECT c.seq, CASE WHEN y.seq IS NULL THEN 'new' WHEN new_completeness > existing_completeness THEN 'supersede' ELSE 'duplicate' END AS action, coalesce(reason, '') AS reason, match_seq, new_completeness, existing_completeness FROM ({C}) c LEFT JOIN ({_LASTS}) y ON y.seq = c.seq"
_MEMBERS = f"""WITH RECURSIVE m AS MATERIALIZED ({_WITHIN}), e AS (SELECT seq_new AS a, seq_old AS b FROM m UNION SELECT seq_old, seq_new FROM m), r AS (SELECT a, a AS root FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.root),
  g AS (SELECT a AS seq, min(root) AS root FROM r GROUP BY a), s AS (SELECT g.root, sig.* FROM g JOIN ({_sig(A)}) sig ON sig.seq = g.seq)"""
_five = ("type", "date", "contractor", "amount", "currency")
_vote = lambda f: f"SELECT root, '{f}' AS field, upper(trim(m_{f})) AS norm, arg_min(m_{f}, seq) AS raw, sum(greatest(completeness, 0.0001)) AS w, max(completeness) AS mx, min(seq) AS fs FROM s WHERE lower(trim({_s('m_' + f)})) NOT IN ('', '-', 'kwota-nieznana', 'n/a', 'nieznana', 'unknown') GROUP BY ALL"
_DOMINANT = ", ".join(f"arg_min(m_{f}, {{'c': -completeness, 's': seq}}) AS d_{f}" for f in _five)
SQL["reconcile_archive"] = f"""{_MEMBERS}, v AS ({" UNION ALL ".join(_vote(f) for f in _five)}), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY root, field ORDER BY w DESC, mx DESC, fs) = 1),
  d AS (SELECT root, {_DOMINANT}, list(document_key ORDER BY completeness DESC, seq) AS ks, list(seq ORDER BY seq)[2] AS second FROM s GROUP BY root)
SELECT d.root AS group_seq, ks[1] AS keep, array_to_string(ks[2:], ',') AS drop, coalesce(m.reason, 'visual') AS reason, {", ".join(f"coalesce((SELECT raw FROM w WHERE w.root = d.root AND w.field = '{f}'), d_{f}) AS m_{f}" for f in _five)}
FROM d LEFT JOIN m ON m.seq_new = d.root AND m.seq_old = d.second"""
SQL["supersessions"] = f"{_MEMBERS} SELECT seq, keep_seq FROM (SELECT seq, first_value(seq) OVER (PARTITION BY root ORDER BY completeness DESC, seq) AS keep_seq FROM s) x WHERE seq <> keep_seq"
_SRC = """SELECT l_orderkey AS cluster, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, l_linenumber % 4 / 4.0::DOUBLE AS weight, CASE WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE r.f END AS flag,
  CASE WHEN l_linenumber % 2 = 0 THEN lower(r.s) ELSE r.s END AS status, CASE WHEN l_linenumber > 5 THEN NULL ELSE CAST(l_linenumber % 2 AS VARCHAR) END AS line, CAST(l_suppkey % 3 AS VARCHAR) AS supplier
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max({'q': l_quantity, 'e': l_extendedprice, 'f': l_returnflag, 's': l_linestatus}) AS r FROM lineitem GROUP BY ALL) g"""
_LONG = " UNION ALL ".join(f"SELECT cluster, seq, weight, '{f}' AS field, {f} AS raw FROM src" for f in ("flag", "status", "line", "supplier"))
SQL["merge_records"] = f"""WITH src AS MATERIALIZED ({_SRC}), l AS ({_LONG}), v AS (SELECT cluster, field, upper(trim(raw)) AS norm, sum(greatest(weight, 0.0001::DOUBLE)::DECIMAL(20, 8)) AS w, max(weight) AS mx, count(*) AS n, arg_min(raw, seq) AS raw, min(seq) AS fs FROM l WHERE lower(trim(coalesce(raw, ''))) NOT IN ('', '-', 'kwota-nieznana', 'n/a', 'nieznana', 'unknown') GROUP BY ALL),
  b AS (SELECT *, count(*) OVER (PARTITION BY cluster, field) AS candidates FROM v QUALIFY row_number() OVER (PARTITION BY cluster, field ORDER BY w DESC, mx DESC, fs) = 1),
  d AS (SELECT cluster, field, raw AS own FROM l QUALIFY row_number() OVER (PARTITION BY cluster, field ORDER BY weight DESC, seq) = 1)
SELECT d.cluster, d.field, CASE WHEN b.norm IS NULL THEN own ELSE b.raw END AS value, CASE WHEN b.norm IS NULL THEN 0.0::DOUBLE ELSE round(b.w::DOUBLE, 4) END AS weight, coalesce(n, 0) AS support, coalesce(candidates, 0) AS candidates,
  b.norm IS NOT NULL AND (lower(trim(coalesce(own, ''))) IN ('', '-', 'kwota-nieznana', 'n/a', 'nieznana', 'unknown') OR upper(trim(own)) <> b.norm) AS filled_gap FROM d LEFT JOIN b ON b.cluster = d.cluster AND b.field = d.field"""

# files and recognised text

_FILES = f"SELECT doc_id AS key, CAST(strlen(text) AS BIGINT) AS file_size, upper(lang) AS file_type, left(sha256(text), 16) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN {_sha16('text')} END AS text_hash FROM documents"
_FID = f"SELECT *, 'UNIV-' || upper(left(file_type, 3)) || '-' || {_sha16("file_type || '|' || file_size || '|' || content_hash || '||' || coalesce(text_hash, '') || '|||||||'")} AS document_id FROM ({_FILES}) f"
SQL["universal_id"] = f"SELECT key, document_id, upper(left(file_type, 3)) AS type_code, content_hash FROM ({_FID}) x"
SQL["compare_pairs"] = f"""WITH f AS MATERIALIZED ({_FID}), p AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY text UNION ALL SELECT doc_id, doc_id + 1 FROM documents)
SELECT a, b, x.document_id AS id1, y.document_id AS id2, x.document_id = y.document_id AS identical_ids, x.file_type IS NOT DISTINCT FROM y.file_type AS same_type, x.file_size = y.file_size AS same_size, x.content_hash = y.content_hash AS same_content_hash, CAST(NULL AS BOOLEAN) AS same_visual_hash, x.text_hash = y.text_hash AS same_text_hash
FROM p JOIN f x ON x.key = a JOIN f y ON y.key = b"""
SQL["universal_verify"] = f"SELECT key, key % 4 = 2 AS verified FROM ({_FID}) x"
_TWO = _join("nip", "day", "money", "'X'").replace("'X'", "no, CASE WHEN k % 2 = 0 THEN dd END")
SQL["canonical_diff"] = f"""SELECT k, CAST(i AS INT) AS position, ['NIP', 'Numer', 'Data', 'Kwota', 'Dodatkowe'][i + 1] AS label, coalesce(x[i + 1], 'BRAK') AS value1, coalesce(y[i + 1], 'BRAK') AS value2, coalesce(x[i + 1], 'BRAK') = coalesce(y[i + 1], 'BRAK') AS same
FROM (SELECT *, unnest(range(greatest(len(x), len(y)))) AS i FROM (SELECT k, string_split({IDENTITIES["invoice_id"][1]}, '|') AS x, string_split({_TWO}, '|') AS y FROM ({B}) b) q) z"""
SQL["ocr_lines"] = """WITH w AS (SELECT conv_id, turn, unnest(range(len(s))) AS i, unnest(s) AS t FROM (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations) c),
  q AS (SELECT conv_id, turn * 1000000 + i AS seq, (i // 6) % 3 AS ln, t, greatest(i % 101 - 1, 0) AS c FROM w WHERE regexp_replace(t, '\\s', '', 'g') <> ''),
  n AS (SELECT *, CASE WHEN lag(ln) OVER (PARTITION BY conv_id ORDER BY seq) = ln THEN 0 ELSE 1 END AS new FROM q), l AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY seq) AS line FROM n)
SELECT conv_id, CAST(line AS BIGINT) AS line, string_agg(t, ' ' ORDER BY seq) AS text, round(avg(c) / 100, 9) AS confidence FROM l GROUP BY conv_id, line"""
SQL["page_combine"] = "SELECT conv_id, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS full_text, round(avg((turn % 5) / 4.0::DOUBLE), 9) AS average_confidence FROM conversations GROUP BY conv_id"
