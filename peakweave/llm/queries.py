"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fmindex import op6_decontamination
from .kneser_ney import op9_quality_classifier
from .language import op7_language_id
from .licenses import op2_license_scan
from .line_dedup import op3_line_dedup
from .pieces import op5_sentencepiece
from .quality_rules import op10_quality_rules
from .simhash import op8_simhash
from .substrings import op1_suffix_dedup
from .wrappers import op4_html_extraction


def licence_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_license_scan."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_quality_rules."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_line_dedup": op3_line_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_decontamination": op6_decontamination,
        "op7_language_id": op7_language_id,
        "op8_simhash": op8_simhash,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_quality_rules": op10_quality_rules,
        "licence_base_columns": licence_base_columns,
        "quality_base_columns": quality_base_columns,
    }


#: Words of whole texts, windows of the items, and every place of a window.
_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
places AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k + 1 : k + n], ' ') AS phrase FROM places),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d JOIN sizes ON len(w) >= n)),
found AS (SELECT DISTINCT doc_id, n, k, item FROM spots JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, n, k FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Every string of 100 bytes, as hexadecimal text, with its first place; removed runs are islands of later places.
_OP1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, k, substr(x, 2 * k + 1, 200) AS string FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS k FROM d WHERE n >= 100)),
f AS (SELECT string, min((doc_id, k)) AS first FROM s GROUP BY 1),
hit AS (SELECT doc_id, k FROM s JOIN f USING (string) WHERE (doc_id, k) > first),
edge AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM hit),
island AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM edge),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM island GROUP BY doc_id, i),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(b) AS n_spans, sha256(unhex(any_value(kept.x))) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, n
"""

_OP2_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
spots AS (SELECT doc_id, w, unnest(range(0, len(w))) AS k FROM d),
hits AS (SELECT doc_id, k, label FROM spots, p WHERE w[k + 1] = split_part(phrase, ' ', 1) AND array_to_string(w[k + 1 : k + len(string_split(phrase, ' '))], ' ') = phrase),
found AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN found USING (doc_id)
"""

_OP10_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
threes AS (SELECT doc_id, k, array_to_string(w[k + 1 : k + 3], ' ') AS three FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS k FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, list(k) AS ks FROM threes GROUP BY doc_id, three HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT k + i) AS n FROM (SELECT doc_id, unnest(ks) AS k FROM again), (VALUES (0), (1), (2)) t(i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other operators' models, alignments or hashes are beyond SQL; tests hold them against brute force."""
    return {"op1_suffix_dedup": _OP1, "op6_decontamination": _OP6, "licence_base_columns": _OP2_BASE, "quality_base_columns": _OP10_BASE}
