"""DuckDB SQL for the name-search queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

CODE = "'01360240043788015936020505'"

CORPUS = """
WITH RECURSIVE parts AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 50 = 0 THEN '-'
         WHEN p_partkey % 7 = 0 THEN substr(split_part(p_name, ' ', 1), 1, 1) || ' ' || split_part(p_name, ' ', 2)
         WHEN p_partkey % 11 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS name,
    CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender
  FROM part),
split AS (SELECT p_partkey, list_filter(regexp_split_to_array(name, '[^a-z]+'), lambda x: x <> '') AS ws FROM parts),
an AS (SELECT p_partkey, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM split)
"""


def _code(word: str) -> str:
    digits = f"list_transform(string_split({word}, ''), lambda c: substr({CODE}, ascii(c) - 96, 1))"
    return f"upper(substr({word}, 1, 1)) || array_to_string(list_transform(list_filter(range(1, length({word}) + 1), lambda i: i = 1 OR {digits}[i] <> {digits}[i - 1]), lambda i: {digits}[i]), '')"


SYN = """(SELECT p_partkey, token, pos FROM an UNION ALL SELECT p_partkey, 'crimson', pos FROM an WHERE token = 'red' UNION ALL SELECT p_partkey, 'band', pos FROM an WHERE token = 'ring')"""
RS = f"(SELECT p_partkey, {_code('token')} AS token, pos FROM an)"
INITIAL = "(SELECT p_partkey, substr(token, 1, 1) AS token, pos FROM an)"


def _near(table: str, where: str, target: int | None, boost: float) -> str:
    freq = "count(*)" if target is None else f"sum(1.0 / (abs(pos - {target}) + 1))"
    return f"SELECT p_partkey, {boost} * sqrt({freq}) AS s FROM {table} WHERE {where} GROUP BY p_partkey"


def _null(target: int | None, boost: float = 0.01) -> str:
    return f"SELECT p_partkey, {boost * (1 if target is None else (1 / (target + 1)) ** 0.5)} AS s FROM parts WHERE name = '-'"


def _guard(sql: str, gender: str | None) -> str:
    return f"SELECT g.* FROM ({sql}) g JOIN parts USING (p_partkey) WHERE gender <> '{gender}'" if gender else sql


def _word(alternatives: list[str], tie: float = 0.0) -> str:
    return f"SELECT p_partkey, max(s) + {tie} * (sum(s) - max(s)) AS s FROM ({' UNION ALL '.join(alternatives)}) GROUP BY p_partkey"


def _all(words: list[str]) -> str:
    return f"SELECT p_partkey, sum(s) AS s FROM ({' UNION ALL '.join(words)}) GROUP BY p_partkey HAVING count(*) = {len(words)}"


def _done(sql: str) -> str:
    return f"{CORPUS} SELECT p_partkey, round(s::DOUBLE, 6) AS score FROM ({sql})"


def _plain(word: str, at: int | None, code: str | None, syn: bool = True, initial: bool = True, gender: str | None = None, exact: str | None = None, fuzzy: str | None = None, null: bool = True, table: str = "an") -> list[str]:
    guard = gender if at is not None else None
    out = [_near(table, f"token = '{word}'", at, 1.0)]
    if exact:
        out.append(f"SELECT p_partkey, 1.01 AS s FROM parts WHERE name = '{exact}'")
    if null:
        out.append(_guard(_null(at), guard))
    if syn:
        out.append(_near(SYN, f"token = '{word}'", at, 0.8))
    if initial:
        out.append(_guard(_near(table, f"token = '{word[0]}'", at, 0.42), guard))
    if code:
        out.append(_guard(_near(RS, f"token = '{code}'", at, 0.75), guard))
    if fuzzy:
        out.append(fuzzy)
    return out


RED, WIDGET = "R906", "W06406"
BASIC = _all([_word(_plain("red", 0, RED)), _word(_plain("widget", 1, WIDGET))])
ONE_EDIT = "substr(token, 1, 2) = '{p}' AND damerau_levenshtein(token, '{w}') <= 1"
FUZZY = f"""SELECT p_partkey, sum(0.2 * (1 - damerau_levenshtein(token, 'widgte') / least(length(token), 6)) * sqrt(n)) AS s
FROM (SELECT p_partkey, token, count(*) AS n FROM an WHERE {ONE_EDIT.format(p='wi', w='widgte')} GROUP BY ALL) GROUP BY p_partkey"""
WILD = lambda p: f"SELECT DISTINCT p_partkey, 0.1 AS s FROM an WHERE token LIKE '{p}'"

LAST = "(SELECT * FROM an UNION ALL SELECT p_partkey, array_to_string(ws, ''), len(ws) - 1 FROM split WHERE len(ws) > 1)"
LAST_SYN = f"(SELECT p_partkey, token, pos FROM {LAST} UNION ALL SELECT p_partkey, 'crimson', pos FROM {LAST} WHERE token = 'red')"
LAST_RS = f"(SELECT p_partkey, {_code('token')} AS token, pos FROM {LAST})"


def _last(word: str, at: int | None, code: str, factor: float = 1.0) -> list[str]:
    return [
        _near(LAST, f"token = '{word}'", at, factor), _null(at, 0.01 * factor), _near(LAST_SYN, f"token = '{word}'", at, 0.8 * factor),
        _near(LAST, f"token = '{word[0]}'", at, 0.42 * factor), _near(LAST_RS, f"token = '{code}'", at, 0.75 * factor),
    ]


REDWIDGET = "R90606406"
CONCAT = f"SELECT p_partkey, max(s) AS s FROM ({_all([_word(_last('red', 0, RED)), _word(_last('widget', 1, WIDGET))])} UNION ALL {_word(_last('redwidget', None, REDWIDGET, 2.0))}) GROUP BY p_partkey"

MV = """(SELECT p_partkey, token, pos FROM an UNION ALL SELECT p_partkey, 'ring', len(ws) + 100 FROM split UNION ALL SELECT p_partkey, gender, len(ws) + 101 FROM split JOIN parts USING (p_partkey))"""
MV_SQL = _word([
    _near(MV, "token = 'ring'", None, 1.0), _null(None), _near(f"(SELECT * FROM {MV} UNION ALL SELECT p_partkey, 'band', pos FROM {MV} WHERE token = 'ring')", "token = 'ring'", None, 0.8),
    _near(MV, "token = 'r'", None, 0.42), _near(f"(SELECT p_partkey, {_code('token')} AS token, pos FROM {MV})", "token = 'R9084'", None, 0.75),
])

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
#: Words by the standard rules, for Latin text: letters joined by : . and apostrophes, digits by . , ; and apostrophes, connectors with either.
UNIT = "[\\p{L}]+(?:[:.·''‘’][\\p{L}]+)*|\\p{Nd}+(?:[.,;''‘’]\\p{Nd}+)*|_"
STANDARD = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '(?:{UNIT})+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]') AND length(x) <= 255)"
#: The norm byte keeps the exponent of 1 / sqrt(n) and two bits of its fraction.
NORM = "CASE WHEN {n} = 0 THEN 0.0 ELSE (1 + floor((1 / sqrt({n}) / pow(2, floor(log2(1 / sqrt({n})))) - 1) * 4) / 4) * pow(2, floor(log2(1 / sqrt({n})))) END::DOUBLE"
NORMED = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n_words, {NORM.format(n='len(ws)')} AS norm FROM w)"""
TFIDF = f"""{NORMED},
d AS (SELECT count(*) AS n, sum(list_contains(ws, 'the')::INT) AS a, sum(list_contains(ws, 'stupid')::INT) AS b FROM n),
i AS (SELECT ln(n / (a + 1.0)) + 1 AS ia, ln(n / (b + 1.0)) + 1 AS ib FROM d),
c AS (SELECT doc_id, norm, len(list_filter(ws, lambda x: x = 'the')) AS ca, len(list_filter(ws, lambda x: x = 'stupid')) AS cb FROM n)
SELECT doc_id, round((sqrt(ca) * ia * ia + sqrt(cb) * ib * ib) * norm / sqrt(ia * ia + ib * ib) * ((ca > 0)::INT + (cb > 0)::INT) / 2, 6) AS score
FROM c, i WHERE ca > 0 OR cb > 0"""
EXPLAIN = f"""{NORMED},
d AS (SELECT ln(count(*) / (sum(list_contains(ws, 'stupid')::INT) + 1.0)) + 1 AS idf FROM n),
c AS (SELECT doc_id, norm, len(list_filter(ws, lambda x: x = 'stupid')) AS freq FROM n)
SELECT doc_id, round(sqrt(freq) * idf * norm, 6) AS value, round(sqrt(freq), 6) AS tf, round(idf, 6) AS idf, round(norm, 6) AS field_norm
FROM c, d WHERE freq > 0"""


def _labelled(word: str, at: int, code: str, tok: int) -> str:
    """A word's alternatives with their fields, in the order of the query."""
    parts_ = [("an", _near("an", f"token = '{word}'", at, 1.0)), ("exact", _null(at)), ("syn", _near(SYN, f"token = '{word}'", at, 0.8)), ("an", _near("an", f"token = '{word[0]}'", at, 0.42)), ("rs", _near(RS, f"token = '{code}'", at, 0.75))]
    return " UNION ALL ".join(f"SELECT p_partkey, {tok} AS tok, {k} AS k, '{field}' AS field, s FROM ({sql})" for k, (field, sql) in enumerate(parts_))


EXPLAIN_NAME = f"""{CORPUS}, e AS ({_labelled('red', 0, RED, 0)} UNION ALL {_labelled('widget', 1, WIDGET, 1)}),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, tok ORDER BY s DESC, k) = 1 AS best FROM e WHERE p_partkey IN (SELECT p_partkey FROM ({BASIC})))
SELECT p_partkey, tok::BIGINT AS tok, field, round(s::DOUBLE, 6) AS score, best FROM r"""
MANY = """(SELECT p_partkey, token, pos FROM an UNION ALL SELECT p_partkey, 'ring', len(ws) + 100 FROM split UNION ALL SELECT p_partkey, gender, len(ws) + 101 FROM split JOIN parts USING (p_partkey))"""
MANY_SYN = f"(SELECT * FROM {MANY} UNION ALL SELECT p_partkey, 'band', pos FROM {MANY} WHERE token = 'ring' UNION ALL SELECT p_partkey, 'crimson', pos FROM {MANY} WHERE token = 'red')"


def _request() -> str:
    word = lambda w, at: _word([_near(MANY, f"token = '{w}'", at, 1.0), _guard(_null(at), "male"), _near(MANY_SYN, f"token = '{w}'", at, 0.5)])
    return _done(_all([word("ring", 0), word("widget", 1)]))


def _open_word(word: str, at: int, fuzzy: bool = True) -> str:
    parts_ = [_near("an", f"token = '{word}'", at, 1.0)]
    if fuzzy:
        near = f"substr(token, 1, 2) = '{word[:2]}' AND damerau_levenshtein(token, '{word}') <= {2 if len(word) > 8 else 1}"
        parts_.append(f"SELECT p_partkey, sum(w) AS s FROM (SELECT p_partkey, token, 0.2 * (1 - damerau_levenshtein(token, '{word}') / least(length(token), {len(word)})) * sqrt(count(*)) AS w FROM an WHERE {near} GROUP BY p_partkey, token) WHERE w > 0 GROUP BY p_partkey")
    return _word(parts_)


def _open() -> str:
    found = {"rign": _open_word("rign", 0), "widgte red": _all([_open_word("widgte", 0), _open_word("red", 1)]), "re* *et": _all([WILD("re%"), WILD("%et")]), "b?lt": WILD("b_lt")}
    return f"{CORPUS} " + " UNION ALL ".join(f"SELECT '{q}' AS query_id, p_partkey, round(s::DOUBLE, 6) AS score FROM ({sql})" for q, sql in found.items())


FIELD_TYPES = """SELECT p_partkey, p_size::BIGINT AS a, round(p_retailprice, 2) AS b, (p_size + 7)::BIGINT AS c, true AS d, p_size - 1.5::DOUBLE AS e, p_name AS f, p_name || '|q' AS g,
  103::BIGINT AS h, 2001::BIGINT AS i, substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) AS j, 'e' || p_name AS k FROM part"""


#: Letters that accent stripping doesn't give, and what stands for them.
ODD = [("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"), ("ł", "l"), ("Ł", "L"), ("ħ", "h"), ("Ħ", "H"), ("ı", "i"), ("²", "2"), ("³", "3"), ("¹", "1"), ("ª", "a"), ("º", "o")]
MARKS = [("'", "’‘‚‛‹›′"), ('"', "“”„«»″"), ("-", "‐‑‒–—")]


def _folding() -> str:
    out = "text"
    for k, v in ODD:
        out = f"replace({out}, '{k}', '{v}')"
    for mark, those in MARKS:
        for c in those:
            out = f"replace({out}, '{c}', '{mark.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT doc_id, sha256(strip_accents({out})) AS folded FROM documents WHERE text IS NOT NULL"


def _bulk() -> str:
    """All names at once: the same alternatives with the query's words as columns."""
    first, second = "split_part(q, ' ', 1)", "split_part(q, ' ', 2)"

    def word(w: str, at: int) -> str:
        near = f"sum(1.0 / (abs(pos - {at}) + 1))"
        of = lambda table, match, boost: f"SELECT q, p_partkey, {boost} * sqrt({near}) AS s FROM names JOIN {table} t ON t.token = {match} GROUP BY q, p_partkey"
        parts_ = [of("an", w, 1.0), of(SYN, w, 0.8), of("an", f"substr({w}, 1, 1)", 0.42), of(RS, _code(w), 0.75), f"SELECT q, p_partkey, {0.01 * (1 / (at + 1)) ** 0.5} AS s FROM names, parts WHERE name = '-'"]
        return f"SELECT q, p_partkey, max(s) AS s FROM ({' UNION ALL '.join(parts_)}) GROUP BY q, p_partkey"

    return f"""{CORPUS}, names AS (SELECT DISTINCT p_name AS q FROM part)
SELECT q AS query_id, p_partkey, round(sum(s)::DOUBLE, 6) AS score FROM ({word(first, 0)} UNION ALL {word(second, 1)}) GROUP BY q, p_partkey HAVING count(*) = 2"""


def _either(scores: list[str]) -> str:
    """Rows that any of them matches, with the sum."""
    return f"SELECT p_partkey, sum(s) AS s FROM ({' UNION ALL '.join(scores)}) GROUP BY p_partkey"


def _words(table: str, words: list[str]) -> str:
    return _either([_near(table, f"token = '{w}'", None, 1.0) for w in words])


TREE_RED, TREE_WIDGET = _word(_plain("red", 0, RED)), _word(_last("widget", None, WIDGET))
TREE_NAMES = f"SELECT t.* FROM ({_all([TREE_RED, TREE_WIDGET])}) t JOIN parts USING (p_partkey) WHERE gender <> 'male'"
TREE_PLACES = f"""SELECT p_partkey, sum(s) AS s FROM ({_near(LAST, "token = 'widget'", 1, 1.0)} UNION ALL SELECT p_partkey, max(2.0 / (abs(pos + 1 - 2) + 1)) AS s FROM an WHERE token = 'ring' GROUP BY p_partkey
  UNION ALL {_words(INITIAL, ["r", "b"])}) GROUP BY p_partkey HAVING count(*) >= 2"""
TREE_NESTED = f"""SELECT p_partkey, a.s + 2 * b.s AS s FROM ({_either([TREE_RED, _near("an", "token LIKE 'bl%'", 0, 1.0)])}) a
  JOIN ({_either([_words(LAST, ["ring", "bolt", "red"]), TREE_WIDGET])}) b USING (p_partkey) JOIN parts USING (p_partkey)
  WHERE NOT (gender = 'female' AND p_partkey IN (SELECT p_partkey FROM an WHERE token = 'ring'))"""
TREE_MIXED = f"""SELECT p_partkey, r.s + coalesce(t.s, 0) AS s FROM ({TREE_RED}) r LEFT JOIN (
  SELECT p_partkey, sum(sqrt(n) * idf * idf * norm) AS s FROM (
    SELECT p_partkey, w, len(list_filter(ws, lambda x: x = w)) AS n, {NORM.format(n="len(ws)")} AS norm FROM texts, (SELECT unnest(['promo', 'ring', 'brand']) AS w) WHERE list_contains(ws, w))
  JOIN (SELECT w, ln((SELECT count(*) FROM texts) / (count(*) + 1.0)) + 1 AS idf FROM texts, (SELECT unnest(['promo', 'ring', 'brand']) AS w) WHERE list_contains(ws, w) GROUP BY w) USING (w) GROUP BY p_partkey) t USING (p_partkey)"""
TEXTS = "texts AS (SELECT p_partkey, regexp_extract_all(lower(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE concat_ws(' ', p_type, p_name, p_brand) END), '[a-z]+|[0-9]+') AS ws FROM part)"
#: Documents after two additions and a deletion; a norm of twice the weight.
CHANGED = f"""w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_concat(['stupid'], {STANDARD}) ELSE {STANDARD} END AS ws FROM documents WHERE doc_id % 5 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 2 = 0))"""
DOUBLE_NORM = NORM.replace("1 / sqrt({n})", "2 / sqrt({n})")
SEGMENTS_TFIDF = f"""WITH {CHANGED}, n AS (SELECT doc_id, ws, {DOUBLE_NORM.format(n="len(ws)")} AS norm FROM w),
d AS (SELECT count(*) AS n, sum(list_contains(ws, 'the')::INT) AS a, sum(list_contains(ws, 'stupid')::INT) AS b FROM n),
i AS (SELECT ln(n / (a + 1.0)) + 1 AS ia, ln(n / (b + 1.0)) + 1 AS ib FROM d),
c AS (SELECT doc_id, norm, len(list_filter(ws, lambda x: x = 'the')) AS ca, len(list_filter(ws, lambda x: x = 'stupid')) AS cb FROM n)
SELECT doc_id, round((sqrt(ca) * ia * ia + sqrt(cb) * ib * ib) * norm / sqrt(ia * ia + ib * ib) * ((ca > 0)::INT + (cb > 0)::INT) / 2, 6) AS score FROM c, i WHERE ca > 0 OR cb > 0"""
SEGMENTS_ORDER = f"WITH {CHANGED} SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2 = 0, doc_id) - 1 AS place FROM w"
VOCABULARY = f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM documents) GROUP BY term"
ASKED = f"SELECT DISTINCT w FROM (SELECT unnest({WORDS}) AS w FROM benchmark)"
#: The distance counts bytes, so the letters beyond ASCII become one byte each.
LATIN = "translate({c}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
FUZZY_WORDS = f"""WITH v AS MATERIALIZED (SELECT term, substr(term, 1, 2) AS start, length(term) AS len FROM ({VOCABULARY})),
p AS MATERIALIZED (SELECT DISTINCT substr(w, 1, length(w) - 2) || substr(w, length(w), 1) || substr(w, length(w) - 1, 1) AS pattern FROM ({ASKED}) WHERE regexp_full_match(w, '[a-z]{{4,}}')),
m AS MATERIALIZED (SELECT pattern, term, damerau_levenshtein({LATIN.format(c='term')}, {LATIN.format(c='pattern')}) AS d FROM p JOIN v ON substr(pattern, 1, 2) = start AND abs(length(pattern) - len) <= 2),
k AS (SELECT pattern, term, 1 - d / least(length(term), length(pattern)) AS weight FROM m WHERE d <= CASE WHEN length(pattern) > 8 THEN 2 ELSE 1 END)
SELECT pattern, term, round(weight::DOUBLE, 6) AS weight FROM k WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY weight DESC, term) <= 50"""
WILDCARD_WORDS = f"""WITH v AS MATERIALIZED ({VOCABULARY}), q AS (SELECT w FROM ({ASKED}) WHERE regexp_full_match(w, '[a-z]{{5,}}')),
p AS MATERIALIZED (SELECT DISTINCT unnest(['*' || substr(w, length(w) - 3), '*' || substr(w, 2, 3) || '*', '?' || substr(w, 2, 20)]) AS pattern FROM q)
SELECT pattern, count(*) AS n_terms, sum(n)::BIGINT AS n_uses FROM p JOIN v ON (CASE WHEN pattern LIKE '*%*' THEN contains(term, pattern[2:4]) WHEN pattern LIKE '*%' THEN suffix(term, pattern[2:]) ELSE length(term) = length(pattern) AND suffix(term, pattern[2:]) END) GROUP BY pattern"""


RED_RING = _all([_word(_plain("red", 0, RED)), _word(_plain("ring", 1, "R9084"))])
#: Words of nine letters and more, those near one of them, and their sums.
LONG_WORDS = """WITH words AS (SELECT doc_id AS p_partkey, regexp_extract_all(lower(text), '[a-z]{9,}') AS ws FROM documents),
w AS (SELECT p_partkey, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM words),
terms AS (SELECT token, damerau_levenshtein(token, '@') AS d FROM (SELECT DISTINCT token FROM w WHERE substr(token, 1, 2) = substr('@', 1, 2))),
best AS (SELECT * FROM terms WHERE d <= 2 QUALIFY row_number() OVER (ORDER BY 1 - d / least(length(token), length('@')) DESC, token) <= 50),
near AS (SELECT w.*, d FROM w JOIN best USING (token)),
fuzzy AS (SELECT p_partkey, sum(s) AS s FROM (SELECT p_partkey, 0.2 * (1 - d / least(length(token), length('@'))) * sqrt(count(*)) AS s FROM near GROUP BY p_partkey, token, d) GROUP BY p_partkey),
exact AS (SELECT p_partkey, 1 / sum(1 / (pos + 1.0)) - 1 AS pos FROM near WHERE d = 0 GROUP BY p_partkey)""".replace("@", "thtiontion")


def oracle_sql() -> dict[str, str]:
    gender = _all([_word(_plain("red", 0, RED, gender="male")), _word(_plain("widget", 1, WIDGET, gender="male"))])
    half = f"SELECT p_partkey, sqrt(count(*) / 2) AS s FROM {INITIAL} WHERE token = 'r' GROUP BY p_partkey"
    return {
        "term_any": _done(_near("an", "token = 'red'", None, 1.0)), "target_pos_0": _done(_near("an", "token = 'widget'", 0, 1.0)),
        "target_pos_1": _done(_near("an", "token = 'widget'", 1, 1.0)), "target_pos_10": _done(_near("an", "token = 'widget'", 10, 1.0)),
        "target_prefix": _done(_near("an", "token LIKE 'wi%'", 1, 1.0)), "target_wildcard": _done(_near("an", "token LIKE 'r%d'", 1, 1.0)),
        "target_fuzzy": _done(_near("an", ONE_EDIT.format(p="ri", w="rign"), 0, 1.0)),
        "name_basic": _done(BASIC), "name_tie": _done(_all([_word(_plain("red", 0, RED), 0.1), _word(_plain("widget", 1, WIDGET), 0.1)])),
        "name_exact": _done(_all([_word(_plain("red", 0, RED, exact="red widget")), _word(_plain("widget", 1, WIDGET, exact="red widget"))])),
        "name_synonym": _done(_all([_word(_plain("crimson", 0, None)), _word(_plain("widget", 1, None))])),
        "name_initial": _done(_all([_word([_near("an", "token = 'r'", 0, 1.0), _null(0), _near(INITIAL, "token = 'r'", 0, 0.42)]), _word(_plain("widget", 1, WIDGET))])),
        "name_null": _done(_word(_plain("nothing", 0, "N8060804", initial=False))),
        "name_phonetic": _done(_all([_word(_plain("redd", 0, RED, initial=False)), _word(_plain("wydget", 1, WIDGET, initial=False))])),
        "name_wildcard": _done(_all([WILD("re%"), WILD("wid_et")])), "initial_wildcard": _done(half),
        "initial_wildcard_positioned": _done(_near(INITIAL, "token = 'r'", 0, 0.1)),
        "name_fuzzy": _done(_word(_plain("widgte", 0, None, fuzzy=FUZZY))), "name_gender": _done(gender),
        "name_surname_concat": _done(CONCAT), "name_surname_single": _done(_word(_last("redwidget", None, REDWIDGET))), "name_mv": _done(MV_SQL),
        "name_top10": _done(BASIC) + " ORDER BY score DESC, p_partkey LIMIT 10",
        "field_query": _done(f"SELECT p_partkey, sum(s) AS s FROM (SELECT p_partkey, token, sqrt(count(*)) AS s FROM {INITIAL} WHERE token IN ('r', 'w') GROUP BY ALL) GROUP BY p_partkey"),
        "payload_position": _done("SELECT p_partkey, max(2.0 / (abs(pos + 1 - 2) + 1)) AS s FROM an WHERE token = 'widget' GROUP BY p_partkey"),
        "surname_key": "SELECT c_custkey, CASE WHEN c_name IS NULL OR trim(c_name) = '' OR regexp_matches(c_name, '5') OR NOT regexp_matches(c_name, '^[A-Za-z]+') THEN '#' ELSE lower(regexp_extract(c_name, '^[A-Za-z]+')) END AS key FROM customer",
        "analysed_tokens": f"{CORPUS} SELECT p_partkey, token, pos::BIGINT AS pos FROM {LAST}",
        "phonetic_codes": f"SELECT word, {_code('word')} AS code FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)",
        "ascii_folding": _folding(), "tfidf_documents": TFIDF, "length_norm": f"{NORMED} SELECT doc_id, n_words, norm FROM n", "explain_terms": EXPLAIN, "bulk_match": _bulk(),
        "replica_order": "SELECT *, row_number() OVER (ORDER BY inflight, server) AS place FROM (SELECT event_type AS server, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS inflight FROM events GROUP BY 1)",
        "tree_names": _done(TREE_NAMES), "tree_places": _done(TREE_PLACES), "tree_nested": _done(TREE_NESTED),
        "tree_mixed": f"{CORPUS}, {TEXTS} SELECT p_partkey, round(s::DOUBLE, 6) AS score FROM ({TREE_MIXED})", "segments_tfidf": SEGMENTS_TFIDF, "segments_order": SEGMENTS_ORDER,
        "bulk_open": _open(), "bulk_top10": f"SELECT query_id, p_partkey, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS place FROM ({_bulk()}) QUALIFY place <= 10",
        "posted_basic": _done(BASIC), "posted_fuzzy": _done(_word(_plain("widgte", 0, None, fuzzy=FUZZY))), "fuzzy_words": FUZZY_WORDS, "wildcard_words": WILDCARD_WORDS, "explain_name": EXPLAIN_NAME, "request": _request(), "name_empty": f"{CORPUS} SELECT p_partkey, 0.0::DOUBLE AS score FROM parts WHERE false",
        "name_total": f"{CORPUS}, b AS ({BASIC}) SELECT p_partkey, round(s::DOUBLE, 6) AS score, (SELECT count(*) FROM b) AS total FROM b ORDER BY score DESC, p_partkey LIMIT 5",
        "response_lines": f"{CORPUS}, b AS (SELECT p_partkey, round(s::DOUBLE, 6) AS score FROM ({RED_RING})) SELECT (SELECT count(*) FROM b) AS numFound, (SELECT max(score) FROM b) AS maxScore, NULL::BIGINT AS p_partkey, NULL::DOUBLE AS score UNION ALL SELECT * FROM (SELECT NULL, NULL, p_partkey, score FROM b ORDER BY score DESC, p_partkey LIMIT 5)",
        "sql_first": _done(BASIC), "sql_last": _done(CONCAT),
        "match_all": _done("SELECT p_partkey, 1.0 AS s FROM parts"),
        "missing_last": f"{CORPUS}, g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN gender END AS g FROM parts) SELECT p_partkey, g, row_number() OVER (ORDER BY g DESC NULLS LAST, p_partkey) AS place FROM g",
        "synonym_position": _done(_near(f"(SELECT * FROM {SYN})", "token = 'band'", 1, 1.0)), "synonym_file": _done(_near(f"(SELECT * FROM {SYN})", "token = 'crimson'", None, 1.0)), "stored_index": _done(CONCAT),
        "whitespace_tokens": f"{CORPUS}, w AS (SELECT p_partkey, list_filter(string_split(upper(name) || ' x', ' '), lambda x: x <> '') AS ws FROM parts) SELECT p_partkey, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM w",
        "analysed_text": f"SELECT doc_id, len(ws)::BIGINT AS n, sha256(array_to_string(ws, ' ')) AS tokens FROM (SELECT doc_id, {STANDARD} AS ws FROM documents)",
        "field_types": FIELD_TYPES, "payload_bytes": "SELECT p_partkey, printf('%08X', p_partkey * 1000) AS bytes, p_partkey * 1000 AS n FROM part",
        "payload_scores": f"{CORPUS} SELECT p_partkey, count(pos)::DOUBLE AS classic, coalesce(sum(pos + 1), 0)::DOUBLE AS flat, coalesce(max(2.0 / (abs(pos + 1 - 2) + 1)), 1)::DOUBLE AS doc_score FROM parts LEFT JOIN (SELECT * FROM an WHERE token = 'widget') USING (p_partkey) GROUP BY p_partkey",
        "phrase_idf": f"WITH w AS (SELECT {WORDS} AS ws FROM documents), d AS (SELECT count(*) AS n, sum(list_contains(ws, 'the')::INT) AS a, sum(list_contains(ws, 'stupid')::INT) AS b FROM w) SELECT round(ln(n / (a + 1.0)) + ln(n / (b + 1.0)) + 2, 6) AS idf, 'idf(docFreq=' || a || ', maxDocs=' || n || ')' AS first_detail FROM d",
        "overlap_norm": f"{CORPUS} SELECT p_partkey, CASE len(ws) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.625 END::DOUBLE AS discounted, CASE len(ws) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS whole FROM split",
        "name_fuzzy_two": f"{LONG_WORDS} SELECT p_partkey, round(max(s)::DOUBLE, 6) AS score FROM (SELECT p_partkey, s FROM fuzzy UNION ALL SELECT p_partkey, sqrt(1 / (pos + 1.0)) AS s FROM exact) GROUP BY p_partkey",
        "target_fuzzy_two": f"{LONG_WORDS} SELECT p_partkey, round(sqrt(sum(1 / (abs(pos - 1) + 1.0)))::DOUBLE, 6) AS score FROM near GROUP BY p_partkey",
        "surname_wildcard": _done(f"SELECT DISTINCT p_partkey, 0.1 AS s FROM {LAST} WHERE token LIKE 'wi%t'"),
    }
