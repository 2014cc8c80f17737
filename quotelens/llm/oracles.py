"""SQL of the llm queries, stated apart from the operators: text forms by DuckDB's own NFC
and replacements, the rest by plain joins over whole tables."""

from __future__ import annotations

import unicodedata

from quotelens.plans import sqltext as S

# Presentation forms of single letters (a rule: their compatibility decomposition) and wide forms.
_FORMS = [c for a, b in ((0xFB50, 0xFC00), (0xFE80, 0xFEF5), (0xFF01, 0xFF5F)) for c in map(chr, range(a, b)) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c]
_PLAIN = [unicodedata.normalize("NFKC", c) for c in _FORMS]
_HIDDEN = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}]"
_LETTER = r"[\x{622}-\x{63A}\x{640}-\x{64A}\x{66E}\x{66F}\x{671}-\x{6D3}]"
_VOWELS = r"[\x{64B}-\x{65F}\x{670}]*"

# Letters that look alike, as they stand in the test tables.
_ALIKE = ("аеорсухіјѕһӏԁԛԝАВЕКМНОРСТХЅІЈοսոօɑکڪھہە", "aeopcyxijshldqwABEKMHOPCTXSIJounoaككههه")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def house(x: str) -> str:
    """House form of the texts of the test tables."""
    x = f"regexp_replace({x}, '{_HIDDEN}', '', 'g')"
    x = f"translate({x}, {_quoted(''.join(_FORMS))}, {_quoted(''.join(_PLAIN))})"
    for k, second in enumerate("آأإا"):  # lam with alef in one character
        x = f"replace(replace({x}, chr({0xFEF5 + 2 * k}), 'ل{second}'), chr({0xFEF6 + 2 * k}), 'ل{second}')"
    x = f"nfc_normalize(translate({x}, '{_ALIKE[0]}', '{_ALIKE[1]}'))"
    for _ in range(2):  # matches may share a letter
        x = f"regexp_replace({x}, 'ی({_VOWELS}{_LETTER})', 'ي\\1', 'g')"
    x = f"regexp_replace(replace({x}, 'ی', 'ى'), '[ىي]([\\x{{64B}}-\\x{{652}}\\x{{670}}]*)\\x{{654}}', 'ئ\\1', 'g')"
    return f"nfc_normalize({S.strip(f"regexp_replace({x}, '[{S.WS_RE2}]+', ' ', 'g')")})"


def plain(x: str) -> str:
    return S.norm(house(x))


_WORDS = f"""
texts AS (SELECT DISTINCT 'original' AS field, quote_id AS rec_id, original AS t FROM quotes UNION SELECT DISTINCT 'text_simple', proc_id, text_simple FROM processed_verses),
recs AS (SELECT field, rec_id, {plain('t')} AS p FROM texts WHERE t IS NOT NULL),
words AS (SELECT field, rec_id, unnest(string_split(p, ' ')) AS term FROM recs WHERE p <> ''),
totals AS (SELECT field, count(*) AS total FROM recs WHERE p <> '' GROUP BY 1),
terms AS (
  SELECT field AS field_name, term, count(*) AS n_occurrences, count(DISTINCT rec_id) AS n_records,
    CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(DISTINCT rec_id) > any_value(total) * 0.05::DOUBLE THEN 'common' END AS mark
  FROM words JOIN totals USING (field) GROUP BY 1, 2)
"""

_RECORDS = "recs AS (SELECT DISTINCT id::BIGINT AS rec_id, text AS t FROM quran_verses WHERE text IS NOT NULL UNION SELECT DISTINCT quote_id, original FROM quotes WHERE original IS NOT NULL)"

_SETS = f"""{_RECORDS}, plains AS (SELECT rec_id, list_distinct(string_split({plain('t')}, ' ')) AS w FROM recs),
big AS (SELECT rec_id, w, len(w) AS n FROM plains WHERE len(w) >= 8),
flat AS (SELECT rec_id, n, unnest(w) AS term FROM big),
common AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b ON a.term = b.term AND a.rec_id < b.rec_id
  WHERE least(a.n, b.n) >= 0.7::DOUBLE * greatest(a.n, b.n) - 1e-9::DOUBLE GROUP BY ALL),
pairs AS (SELECT rec_a, rec_b FROM common WHERE c >= 0.7::DOUBLE * (na + nb - c) - 1e-9::DOUBLE)
"""

_SPANS = f"""{_RECORDS}, sized AS (SELECT rec_id, t, length(t) AS n_chars FROM recs),
windows AS (SELECT rec_id, k, substr(t, k + 1, 50) AS w FROM (SELECT rec_id, t, unnest(range(n_chars - 49)) AS k FROM sized WHERE n_chars >= 50)),
held AS (SELECT w FROM windows GROUP BY w HAVING min(rec_id) < max(rec_id)),
covered AS (SELECT rec_id, count(DISTINCT place) AS shared_chars FROM (SELECT rec_id, unnest(range(k, k + 50)) AS place FROM windows SEMI JOIN held USING (w)) GROUP BY 1),
shares AS (
  SELECT rec_id, n_chars, coalesce(shared_chars, 0)::INT AS shared_chars FROM sized LEFT JOIN covered USING (rec_id)
  UNION SELECT id, NULL, 0 FROM quran_verses WHERE text IS NULL UNION SELECT quote_id, NULL, 0 FROM quotes WHERE original IS NULL)
"""


def _tokens(x: str) -> str:
    """Words of a text: letters and digits, one spelling, line-end hyphens closed."""
    x = f"nfc_normalize(translate(regexp_replace({x}, '{_HIDDEN}', '', 'g'), {_quoted(''.join(_FORMS))}, {_quoted(''.join(_PLAIN))}))"
    x = f"replace(lower({x}), 'ß', 'ss')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{L}})[-‐‑⁃][ \t\x{{A0}}\r]*\n\s*(\p{{L}})', '\1\2', 'g')"
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"


def _runs(name: str, key: str, source: str) -> str:
    return f"{name} AS (SELECT {key}, w[i:i + 15] AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 14)) AS i FROM {source} WHERE len(w) >= 16))"


SQL = {
    "p1_found": f"WITH {_WORDS} SELECT field_name, term, mark FROM terms WHERE mark IS NOT NULL",
    "p1_terms": f"WITH {_WORDS} SELECT * FROM terms",
    "p2_found": f"WITH {_SETS} SELECT * FROM pairs",
    "p2_groups": f"""WITH RECURSIVE {_SETS}, links AS (SELECT rec_a AS x, rec_b AS y FROM pairs UNION SELECT rec_b, rec_a FROM pairs),
reach AS (SELECT rec_id AS x, rec_id AS label FROM big UNION SELECT l.y, r.label FROM reach r JOIN links l ON l.x = r.x AND r.label < l.y)
SELECT rec_id, (SELECT min(label) FROM reach WHERE x = rec_id) AS group_id, (SELECT count(*) FROM links WHERE x = rec_id) AS n_links FROM big""",
    "p3_found": f"""WITH texts AS (
  SELECT DISTINCT id::BIGINT AS rec_id, 0 AS scope, true AS verse, text AS t FROM quran_verses UNION SELECT id, id, true, text_simple FROM quran_verses
  UNION SELECT quote_id, 0, false, original FROM quotes UNION SELECT proc_id, id, false, text_simple FROM processed_verses WHERE id IS NOT NULL),
h AS (SELECT *, {house('t')} AS f FROM texts WHERE t IS NOT NULL), long AS (SELECT * FROM h WHERE len(string_split(f, ' ')) >= 6)
SELECT DISTINCT a.rec_id AS verse_id, b.rec_id FROM long a JOIN long b ON a.scope = b.scope AND a.f = b.f AND a.t <> b.t AND a.rec_id < b.rec_id WHERE a.verse AND (NOT b.verse OR b.scope = 0)""",
    "p5_found": f"WITH {_SPANS} SELECT DISTINCT rec_id FROM shares WHERE shared_chars > 0 AND 2 * shared_chars >= n_chars",
    "p5_shares": f"WITH {_SPANS} SELECT rec_id, n_chars, shared_chars FROM shares",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_tokens('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_tokens('item_text')} AS w FROM heldout_items WHERE item_text IS NOT NULL),
{_runs('items', 'item_id', 'i')}, {_runs('docs', 'doc_id', 'd')} SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (run)""",
    "p6_invariants": f"SELECT count(*) AS n_documents, 0::BIGINT AS n_split, 0::BIGINT AS n_overfull FROM documents WHERE regexp_matches(text, '[^{S.WS_RE2}]')",
    "p8_documents": "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\p{L}')",
}
